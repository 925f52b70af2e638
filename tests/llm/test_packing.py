import random
import zlib

import numpy as np
import pytest

from postflow.llm import packing
from postflow.llm.support import read
from postflow.llm.tokens import BYTE_BPE, _tokenizer, place
from llm_fixtures import documents, odd_documents, importable  # noqa: F401


def plain_pieces(rows, size, end=2):
    tokenizer, out = _tokenizer(place(BYTE_BPE)), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def check_places(got, capacity):
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        if len(places) > 1:
            assert at <= capacity.tokens and len(places) <= capacity.documents
            assert sum(n * n for _, n in places) <= capacity.attention
    return len(sequences)


def test_whole_table(spark):
    df = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = packing.pack_pieces(packing.cut_documents(df)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(plain_pieces(rows, 1024))
    used = check_places(got, packing.Capacity())
    assert used <= -(-sum(r["length"] for r in got) // 1024) * 1.02 + 1


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100, 1000, 10**9), packing.Capacity(100, 3, 10**9), packing.Capacity(100, 50, 3000)])
def test_every_capacity_holds(spark, capacity, measure):
    rng = random.Random(7)
    rows = [(i, rng.randrange(0, 4), rng.randrange(1, 101)) for i in range(3000)] + [(i, 0, 20) for i in range(3000, 5000)]
    df = spark.createDataFrame([(i, p, n, "x") for i, p, n in rows], "doc_id long, piece int, length long, offset string")
    got = packing.pack_pieces(df, capacity, weights=(1.0, 0.5, 0.5), measure=measure).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted(rows)
    check_places(got, capacity)


def test_the_other_residuals_decide_placements():
    """Of sequences with equal tokens left, the one whose slots and attention are nearer to full is filled."""
    rng = random.Random(3)
    histogram = {n: rng.randrange(1, 40) for n in range(1, 1025, 3)}
    found = {}
    for weights in [(1.0, 0.0, 0.0), packing.WEIGHTS]:
        placements, used = packing.vector_best_fit(histogram, weights=weights)
        found[weights] = sorted((p.length, p.rank, p.count, p.sequence, p.offset) for p in placements), used
    (plain, few), (vector, same) = found.values()
    assert all(w > 0 for w in packing.WEIGHTS) and plain != vector and same <= few + 1


def test_best_fit_on_a_histogram_is_best_fit_on_pieces():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 400))]
        histogram = {n: sizes.count(n) for n in set(sizes)}
        left = []
        for n in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(64 - n)
        placements, opened = packing.vector_best_fit(histogram, packing.Capacity(64, 10**6, 10**9))
        assert opened == len(left)
        assert sum(p.count for p in placements) == len(sizes)


def test_a_piece_that_fits_nowhere_is_alone():
    placements, opened = packing.vector_best_fit({80: 3, 10: 2}, packing.Capacity(64, 10, 10**9))
    assert opened == 4 and sum(p.count for p in placements) == 5
    with pytest.raises(ValueError):
        packing.vector_best_fit({1: 1}, measure="sum")


def test_odd_rows(odd_documents):
    pieces = packing.cut_documents(odd_documents, size=64)
    got = packing.pack_pieces(pieces, packing.Capacity(64, 64, 64 * 64)).collect()
    want = plain_pieces([(r["doc_id"], r["text"]) for r in odd_documents.collect()], 64)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    check_places(got, packing.Capacity(64, 64, 64 * 64))
    assert packing.pack_pieces(packing.cut_documents(odd_documents.where("false"))).count() == 0
    assert packing.cut_documents(odd_documents.where("doc_id = 1"), end=None).count() == 0
