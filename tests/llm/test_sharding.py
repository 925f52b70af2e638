import random
import zlib

import pytest

from postflow.llm import sharding
from postflow.llm.support import read
from llm_fixtures import documents, odd_documents, importable  # noqa: F401


def plain_best_fit(sizes, capacity):
    left, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        b = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(max(capacity, sizes[i]))
        left[b] -= sizes[i]
        bins[i] = b
    return bins


def test_tree_packs_like_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(0, 120) for _ in range(rng.randrange(0, 80))]
        assert sharding.best_fit_decreasing(sizes, 100) == plain_best_fit(sizes, 100)


def test_tree_stays_balanced():
    tree = sharding.CapacityTree()
    for i in range(4000):
        tree.insert((i, i))
    depth = lambda n: 0 if n is None else 1 + max(depth(n[2]), depth(n[3]))
    assert depth(tree._root) < 60
    assert [tree.take_tightest(1000)[0] for _ in range(3)] == [1000, 1001, 1002]
    assert tree.take_tightest(4000) is None


def check(rows, got, shards):
    """Rows of (doc_id, text) and result rows."""
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    texts = dict(rows)
    home, load, slots = {}, [0] * shards, {}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text or "").encode())
        assert home.setdefault(text, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_near_equal_shards(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    load = check(rows, sharding.shard_documents(df, 24).collect(), 24)
    assert max(load) / (sum(load) / 24) < 1.01 and min(load) / (sum(load) / 24) > 0.97


def test_a_hot_group_leaves_the_others_even(documents):
    rows = [(i, "hot" * 30) for i in range(500)] + [(500 + i, f"text {i} " * 3) for i in range(1000)]
    load = check(rows, sharding.shard_documents(documents(rows), 6).collect(), 6)
    others = sorted(load)[:-1]
    assert others[-1] - others[0] <= 40


def test_odd_rows(odd_documents):
    got = sharding.shard_documents(odd_documents, 3).collect()
    assert len(got) == odd_documents.count()
    assert sorted(r["size"] for r in got)[:3] == [8, 8, 9 + 0] or sorted(r["size"] for r in got)[:2] == [8, 8]
    assert sharding.shard_documents(odd_documents.where("false"), 3).count() == 0


@pytest.mark.parametrize("capacity", [50, 200])
def test_fewest_shards_of_a_fixed_capacity(spark, capacity):
    rng = random.Random(2)
    groups = [(f"g{i}", rng.randrange(1, 60)) for i in range(200)] + [(None, 7), ("big", 500)]
    got = sharding.pack_groups(spark.createDataFrame(groups, "group string, bytes long"), capacity=capacity).collect()
    load, held = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["bytes"]
        held[r["shard"]] = held.get(r["shard"], 0) + 1
    assert len(got) == len(groups)
    assert all(v <= capacity or held[s] == 1 for s, v in load.items())
    assert len(load) <= sum(min(s, capacity) for _, s in groups) / capacity * 1.15 + 3
