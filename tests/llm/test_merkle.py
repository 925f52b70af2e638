import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.llm import merkle
from postflow.llm.queries import op11_merkle_manifest
from postflow.llm.support import read
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The top of a tree, and for each node the siblings of its way up."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for k in range(len(run)):
                for i in under[at + k]:
                    ways[i].append((run[:k], run[k + 1:]))
            up.append(h(*run))
            above.append([i for k in range(len(run)) for i in under[at + k]])
        nodes, under = up, above
    return nodes[0], ways


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subs, ways = [], []
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        sub, way = tree([leaf(r, r["text"]) for r in sources[s]])
        subs.append(sub)
        ways.append(way)
    root, top = tree(subs)
    out = []
    for s, sub, way, upper in zip(order, subs, ways, top):
        for r, own in zip(sources[s], way):
            proof = own + upper
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in proof:
                node = h(*left, node, *right)
            digest = h(*[d for left, right in proof for d in left + right])
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, digest, node, node == root))
    return sorted(out, key=repr)


def found(df):
    manifest = merkle.build_manifest(df, claim=merkle.tampered_leaf())
    proved = merkle.prove(manifest, manifest.leaves)
    rows = proved.select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), merkle.proof_digest(F.col("proof")).alias("p"),
        merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")).alias("f")).collect()
    return sorted(((*r, r["f"] == r["root"]) for r in rows), key=repr)


def plain(df):
    return [r.asDict() for r in df.select(*merkle.FIELDS).collect()]


def test_whole_table_against_brute_force(spark):
    got = op11_merkle_manifest(spark, SF)
    want = brute(plain(read(spark, SF, "documents")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [257, 1, 16, 33], [2] * 18])
def test_trees_of_all_heights(documents, sizes):
    rows = [(100 * s + i, f"Text {i} of {s}", "en", f"src{s}") for s, n in enumerate(sizes) for i in range(n)]
    random.Random(len(rows)).shuffle(rows)
    df = documents(rows)
    assert found(df) == brute(plain(df))


def test_odd_rows(odd_documents):
    assert found(odd_documents) == brute(plain(odd_documents))
    empty = odd_documents.where("false")
    assert found(empty) == [] and merkle.build_manifest(empty).root is None


def test_repeated_rows_and_null_ids(documents):
    """Equal rows make equal runs, which are stored once and must not multiply proofs."""
    df = documents([(5, "Same", "en", "a")] * 600 + [(None, "x", None, None)] * 3 + [(1, "y", "en", None), (-7, "É", "fr", "a")])
    assert found(df) == brute(plain(df))


def test_null_values_differ_from_dashes(documents):
    leaves = merkle.build_manifest(documents([(1, None), (1, "-"), (1, "")])).leaves
    assert leaves.select("leaf").distinct().count() == 3


def test_some_requests(documents):
    df = documents([(i, f"T{i}", "en", f"s{i % 3}") for i in range(700)])
    manifest = merkle.build_manifest(df)
    asked = manifest.leaves.where("doc_id in (0, 3, 400, 699)").withColumn("path", F.lit("mine"))
    asked = asked.unionByName(asked.limit(1)).unionByName(asked.limit(1).withColumn("rank", F.lit(10**6).cast("long")))
    proved = merkle.prove(manifest, asked).withColumn("again", merkle.fold(F.col("leaf"), F.col("proof")))
    rows = proved.collect()
    assert len(rows) == 5 and all(r["again"] == manifest.root and r["path"] == "mine" for r in rows)


def test_leaves_are_hashed_without_python(spark):
    plan = plan_of(op11_merkle_manifest(spark, SF))
    assert "Python" not in plan and "Arrow" not in plan
