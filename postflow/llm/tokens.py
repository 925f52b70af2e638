"""Token ids by a public tokenizer file, inside tasks."""

import base64
import os
import re
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
# What the rank form of the vocabulary is not used for: characters whose class may differ between
# Unicode versions, and texts that may spell a special token.
_SLOW = re.compile(r"[^\x00-ɏ]|<\|")


def place(name: str) -> str:
    """Where an installed tokenizer file is; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = BYTE_BPE, ranks: str | None = BYTE_BPE_RANKS) -> list[int]:
    """Ids of `text` without added special tokens, as `tokenizers` gives them.

    `ranks` names the same vocabulary in rank form, which is four times as fast and has the same
    ids on the texts it is used for; None keeps to `vocabulary`.
    """
    if ranks is not None and not _SLOW.search(text):
        return _ranks(place(ranks)).encode_ordinary(text)
    return _tokenizer(place(vocabulary)).encode(text, add_special_tokens=False).ids


def id_array(text: str | None, end: int | None, vocabulary: str, ranks: str | None) -> np.ndarray:
    """Ids as little-endian 32-bit numbers, with `end` after the last; null text is empty."""
    ids = encode(text, vocabulary, ranks) if text else []
    return np.array(ids if end is None else [*ids, end], dtype="<u4")
