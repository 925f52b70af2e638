import pytest

from postflow.llm import lengths
from postflow.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, _SLOW, _tokenizer, encode, place
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(text):
    return _tokenizer(place(BYTE_BPE)).encode(text, add_special_tokens=False).ids


def test_rank_form_gives_the_same_ids(spark):
    chars = [chr(i) for i in range(0x250)]
    samples = ["".join(chars)] + [f"a{c}b {c} {c}{c}1{c}\n{c}'s  {c}" for c in chars]
    samples += [f"{a}{b}x" for a in "  \t\n\r\x0b\x0c\x1c\x85\xa0" for b in "  \t\n\r\x0b\x0c\x1c\x85\xa0'_²½"]
    samples += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in samples:
        assert not _SLOW.search(text)
        assert encode(text) == plain(text)


def test_other_texts_go_to_the_tokenizer():
    for text in ("𝔘 and 漢字", "a<|endoftext|>b", "‎"):
        assert _SLOW.search(text) and encode(text) == plain(text)


def test_totals_against_brute_force(spark, odd_documents):
    rows = [r["text"] for r in odd_documents.collect()]
    n = sorted(len(plain(t)) if t else 0 for t in rows)
    got = lengths.length_totals(lengths.length_histogram(odd_documents), block=8).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(set(n))
    for r in got:
        limit = r["n_tokens"]
        assert r["documents"] == n.count(limit)
        assert r["at_least"] == sum(x >= limit for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    one = lengths.truncated_total(lengths.length_histogram(odd_documents), 50).first()
    assert tuple(one) == (len(n), sum(n), sum(min(x, 50) for x in n))


def test_empty_table(odd_documents):
    empty = lengths.length_histogram(odd_documents.where("false"))
    assert lengths.length_totals(empty).count() == 0
    assert tuple(lengths.truncated_total(empty, 5).first()) == (0, 0, 0)
