import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from postflow.llm import centroids
from postflow.llm.queries import op13_centroid_clusters
from postflow.llm.support import read
from llm_fixtures import importable  # noqa: F401

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("v", T.StringType()), T.StructField("cluster", T.StringType()), T.StructField("distance", T.StringType()),
])


def brute(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [min(1 << 27, max(-(1 << 27), math.floor(1024 * float(x)))) for x in e]))
    place = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(kept, key=place)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(col) // len(vs) for col in zip(*vs)]
    final = [(i, *near(v)) for i, v in kept]
    sums = {}
    for _, d, n in final:
        sums[n] = sums.get(n, 0) + d
    digest = lambda n: hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()
    cap = (1 << 63) - 1
    return sorted(((i, n, d, min(cap, sums[n]), min(cap, sum(sums.values())), digest(n)) for i, d, n in final), key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in centroids.cluster(df, **kw).collect()), key=repr)


def make(spark, rows):
    return spark.createDataFrame([(i, e, "a", "b", "c") for i, e in rows], SCHEMA)


def pairs(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_whole_table_against_brute_force(spark):
    df = read(spark, SF, "embeddings").limit(200)
    assert found(df) == brute(pairs(df))


def test_walk_finds_the_nearest():
    rng = np.random.default_rng(1)
    for dims, k, spread in [(1, 8, 5), (2, 8, 3), (3, 5, 1000), (64, 8, 2), (64, 8, 2000), (4, 1, 9), (6, 300, 50)]:
        cents = rng.integers(-spread, spread, (k, dims))
        vectors = rng.integers(-spread, spread, (500, dims))
        nearest, distance = centroids.Lists(cents).walk(vectors)
        exact = ((vectors[:, None, :] - cents[None]) ** 2).sum(axis=2)
        assert (distance == exact.min(axis=1)).all() and (nearest == exact.argmin(axis=1)).all()


def test_walk_ends_early():
    """With far centroids in few dimensions most are never measured."""
    cents = np.arange(400)[:, None] * 1000 + np.zeros((1, 2), np.int64)
    lists = centroids.Lists(cents.astype(np.int64))
    touched = []
    plain = np.einsum
    try:
        centroids.np.einsum = lambda *a: touched.append(len(a[1])) or plain(*a)
        lists.walk(np.full((10, 2), 5003, np.int64))
    finally:
        centroids.np.einsum = plain
    assert sum(touched) <= 40


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [[float(np.sin(i * j)) for j in range(64)] for i in range(30)]
    rows = [(i, e) for i, e in enumerate(base)]
    rows += [(100, None), (101, []), (102, base[0][:63]), (103, base[0] + [1.0]), (104, [nan] + base[0][1:]), (105, [inf] + base[0][1:]),
             (106, [None] + base[0][1:]), (107, [0.0] * 64), (None, base[1]), (None, base[2]), (3, base[5]), (3, base[3])]
    df = make(spark, rows)
    stored = pairs(df)
    assert found(df) == brute(stored)
    assert found(df.where("false")) == []
    few = df.where("vec_id in (1, 2, 107)")
    assert found(few) == brute(pairs(few)) and len(found(few)) == 3


def test_huge_components(spark):
    rows = [(i, [1e38 if (i + j) % 3 else -1e30 for j in range(64)]) for i in range(12)] + [(50, [0.5] * 64), (51, [-0.0005] * 64)]
    df = make(spark, rows)
    assert found(df) == brute(pairs(df))


@pytest.mark.parametrize("k, rounds", [(1, 2), (3, 0), (20, 3)])
def test_other_numbers(spark, k, rounds):
    df = read(spark, SF, "embeddings").limit(60)
    assert found(df, k=k, rounds=rounds) == brute(pairs(df), k, rounds)


def test_equal_vectors(spark):
    df = make(spark, [(i, [1.0] * 64) for i in range(40)])
    assert found(df) == brute(pairs(df)) and {r[1] for r in found(df)} == {0}


def test_query_keeps_every_vector(spark):
    assert op13_centroid_clusters(spark, SF).count() == read(spark, SF, "embeddings").count()
