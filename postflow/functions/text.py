"""Text cleaning, tokens and term tests."""

import functools
import operator
import re

from pyspark.sql import Column, functions as F

# Fixed values.
NOISE = r"http\S+|@\S+|#\S+"  # links, mentions and hashtags, each up to the next whitespace
TOKEN = r"[\p{L}\p{N}]+"

_TOKEN_CHAR = r"[\p{L}\p{N}]"


def clean_text(text: Column) -> Column:
    """`text` without links, mentions and hashtags; the spaces around them stay."""
    return F.regexp_replace(text, NOISE, "")


def tokens(text: Column) -> Column:
    """Lowercase runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_counts(text: Column) -> Column:
    """`(term, tf)` of each distinct token, from runs of equal ones in the sorted tokens; null without tokens.

    One-element arrays bind what is looked at several times.
    """

    def counted(words: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
        )
        return F.transform(F.array(heads), lambda h: F.transform(h, lambda at, n: F.struct(
            F.get(words, at).alias("term"), (F.coalesce(F.get(h, n + 1), F.size(words)) - at).cast("bigint").alias("tf")
        )))[0]

    return F.transform(F.array(F.sort_array(tokens(text))), lambda words: F.when(F.size(words) > 0, counted(words)))[0]


def word_places(text: Column, span: int) -> Column:
    """`(term, block, gaps, first)` of each distinct token and block of `span` words that it is in.

    `gaps` are its positions there, the first one counted from the block's beginning, each other
    one from the position before; `first` marks a token's first block. Null without tokens.
    """

    def block(entry: Column) -> Column:
        return F.floor(entry["pos"] / span).cast("int")

    def placed(words: Column) -> Column:
        entry = lambda i: F.get(words, i)
        new_term = lambda i: (i == 0) | (entry(i)["term"] != entry(i - 1)["term"])
        heads = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: new_term(i) | (block(entry(i)) != block(entry(i - 1)))
        )

        def row(at: Column, end: Column) -> Column:
            gaps = F.transform(F.slice(words, at + 1, end - at), lambda e, j: e["pos"] - F.when(
                j == 0, block(e) * span
            ).otherwise(entry(at + j - 1)["pos"]))
            return F.struct(
                entry(at)["term"].alias("term"), block(entry(at)).alias("block"), gaps.alias("gaps"), new_term(at).alias("first")
            )

        return F.transform(F.array(heads), lambda h: F.transform(
            h, lambda at, n: row(at, F.coalesce(F.get(h, n + 1), F.size(words)))
        ))[0]

    entries = F.sort_array(F.transform(tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return F.transform(F.array(entries), lambda words: F.when(F.size(words) > 0, placed(words)))[0]


def normal_terms(terms) -> list[str]:
    """Distinct lowercase search terms; a term must be one token."""
    found = list(dict.fromkeys(str(t).lower() for t in terms))
    bad = [t for t in found if not re.fullmatch(r"[^\W_]+", t)]
    if bad or not found:
        raise ValueError(f"search terms must be single words, got {bad or terms!r}")
    return found


def has_terms(text: Column, terms: list[str], every: bool) -> Column:
    """True where any, or every one, of the terms is a token of `text`.

    Each pattern starts with the term itself, so the engine looks for a literal and tests its
    surroundings only where it occurs; no token array is built. The one-element array binds the
    text: an expression behind it is computed once, not once per term.
    """

    def test(lowered: Column) -> Column:
        found = [
            lowered.rlike(f"{t}(?!{_TOKEN_CHAR})(?<!{_TOKEN_CHAR}{t})") for t in terms
        ]
        return functools.reduce(operator.and_ if every else operator.or_, found)

    return F.exists(F.array(F.lower(text)), test)
