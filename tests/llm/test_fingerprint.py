import hashlib
import re

import pytest
from pyspark.sql import functions as F

from postflow.llm import fingerprint
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_hashes(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words)] if 0 < len(words) <= 5 else [" ".join(words[i:i + 5]) for i in range(len(words) - 4)]
    return {hashlib.md5(r.encode()).hexdigest()[:16] for r in runs}


def plain(text):
    hashes = all_hashes(text)
    return sorted({h for h in hashes if h < fingerprint.KEEP} | ({min(hashes)} if hashes else set()))


def near(one, other):
    a, b = all_hashes(one), all_hashes(other)
    below = [{h for h in x if h < fingerprint.KEEP} for x in (a, b)]
    a, b = below if all(below) else (a, b)
    if not a and not b:
        return 1.0
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_against_brute_force(odd_documents):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.dropDuplicates(["doc_id"]).collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.edited_likeness(odd_documents.dropDuplicates(["doc_id"])).collect()}
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == "".join(plain(text)) and r["edited_fingerprint"] == "".join(plain(changed))
        assert r["near_edited"] == pytest.approx(near(text, changed))
        assert r["near_next"] == pytest.approx(near(text, after))


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_next_row_over_many_ranges(spark, documents, monkeypatch, n):
    monkeypatch.setattr(fingerprint, "ROWS_A_BUCKET", 4)
    keys = [(k * 7919) % 100_003 - 50_000 for k in range(n)]
    rows = fingerprint.with_next(documents([(k, f"t{k}") for k in keys]), ["text"]).collect()
    order = sorted(keys, reverse=True)
    assert {r["doc_id"]: r["next_text"] for r in rows} == {k: f"t{order[(i + 1) % n]}" for i, k in enumerate(order)}


def test_repeated_and_null_keys_keep_all_rows(spark, documents):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")]
    got = fingerprint.with_next(documents(rows), ["text"]).collect()
    assert sorted(r["text"] for r in got) == list("abcde")
    # Every row is the next one of some row.
    assert sorted(r["next_text"] for r in got)[0] == "a" and len({r["next_text"] for r in got}) >= 4


def test_sketches_merge(spark):
    texts = [("a b c d e f g h i j k l", "x y z"), ("", "a b c"), ("q w e r t y u", "q w e r t y u")]
    df = spark.createDataFrame(texts, "one string, other string")
    one, other = fingerprint.sketch(F.col("one")), fingerprint.sketch(F.col("other"))
    for r in df.select("one", "other", fingerprint.merge(one, other).alias("m")).collect():
        both = set(plain(r["one"])) | set(plain(r["other"]))
        assert r["m"] == sorted({h for h in both if h < fingerprint.KEEP} | ({min(both)} if both else set()))


def test_containment_of_a_short_text_in_a_long_one(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[1000:1400]), " ".join(f"v{i}" for i in range(400)))], "long string, part string, other string")
    long, part, other = (fingerprint.sketch(F.col(c)) for c in ("long", "part", "other"))
    inside = lambda a, b: fingerprint.containment(fingerprint.comparable(a, b))
    r = df.select(inside(long, part).alias("in"), inside(long, other).alias("out")).first()
    assert r["in"] > 0.99 and r["out"] == 0.0


def test_windows_of_all_sizes_are_contained(spark):
    """Every window of 5 to 20 words of a text lies wholly inside it; shorter ones have shingles of their own."""
    words = [f"w{i}" for i in range(1000)]
    long = " ".join(words)
    rows = [(n, " ".join(words[at:at + n]), long) for n in range(1, 21) for at in range(0, 980, 70)]
    df = spark.createDataFrame(rows, "n int, part string, whole string")
    by_sketch = fingerprint.comparable(fingerprint.sketch(F.col("part")), fingerprint.sketch(F.col("whole")))
    either = F.coalesce(by_sketch, fingerprint.comparable_texts(F.col("part"), F.col("whole")))
    got = df.select("n", "part", fingerprint.containment(by_sketch).alias("told"), fingerprint.containment(either).alias("found"),
                    fingerprint.resemblance(either).alias("alike")).collect()
    assert {r["found"] for r in got if r["n"] >= 5} == {1.0} and {r["told"] for r in got if r["n"] >= 5} == {1.0, None}
    assert all(r["found"] == near(r["part"], long) and (r["told"] in (None, r["found"])) and 0 <= r["alike"] <= 1 for r in got)


def test_fingerprint_replaces_a_column_of_its_name(odd_documents):
    got = fingerprint.add_fingerprint(odd_documents, name="score")
    assert got.columns == odd_documents.columns and dict(got.dtypes)["score"] == "array<string>"
    assert fingerprint.edited_likeness(odd_documents.where("false")).count() == 0
