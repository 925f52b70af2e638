"""Positional index and block index, against plain Python over the same posts."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.operators import positions
from postflow.operators.block_index import read_blocks, write_blocks
from postflow.operators.positions import phrase_words, position_postings, read_positions, write_positions
from postflow.operators.text_index import postings, ranked_search
from postflow.functions.text import tokens

WORDS = ["rain", "river", "the", "über", "42"]


def make_texts(n=250, seed=5):
    rng = random.Random(seed)
    for i in range(n):
        kind = rng.randrange(6)
        words = [rng.choice(WORDS) if rng.random() < 0.8 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        if kind == 0:
            words = ["the"] * rng.randrange(30)
        yield i, None if kind == 1 else rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)
    yield n, "only one rare word here: zebra"


TEXTS = list(make_texts())


def words(text):
    return phrase_words(text) if text and text.strip() else []


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").repartition(4).cache()


@pytest.fixture(scope="module", params=[4, 256])
def index(request, spark, df, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("positions"))
    write_positions(position_postings(df, span=request.param), path, buckets=8, span=request.param)
    return read_positions(spark, path)


def test_blocks_hold_all_positions(spark, df, index):
    rows = spark.read.parquet(f"{index.path}/positions").withColumn("at", positions.places(index.span)).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.block):
        assert all(p // index.span == r.block for p in r.at) and list(r.at) == sorted(set(r.at))
        got[r.id, r.term] += r.at
    want = collections.defaultdict(list)
    for i, text in TEXTS:
        for p, w in enumerate(words(text)):
            want[i, w].append(p)
    assert got == want
    counts = collections.Counter(w for _, w in want)
    assert {r.term: r.df for r in index.counts(list(counts)).collect()} == counts


@pytest.mark.parametrize("phrase", ["the river", "River, rain the", "the the the", "rain river rain", "über", "zebra", "the zebra", "one rare word here", "absent", "the absent"])
def test_phrases_against_plain_search(index, phrase):
    asked = phrase_words(phrase)
    if len(asked) > index.span:
        return
    want = {}
    for i, text in TEXTS:
        w = words(text)
        hits = sum(w[p:p + len(asked)] == asked for p in range(len(w) - len(asked) + 1))
        if hits:
            want[i] = hits
    assert {r.id: r.hits for r in index.phrase_search(phrase).collect()} == want


@pytest.mark.parametrize("terms, within", [(["the", "river"], 2), (["the", "river"], 4), (["42", "über", "rain"], 3), (["42", "über", "rain"], 4),
                                           (["the"], 1), (["the", "zebra"], 4), (["absent", "the"], 3)])
def test_near_words_against_plain_search(index, terms, within):
    want = {}
    for i, text in TEXTS:
        w = words(text)
        runs = [b - a + 1 for a in range(len(w)) for b in range(a, min(len(w), a + within)) if set(terms) <= set(w[a:b + 1])]
        if runs:
            want[i] = min(runs)
    assert {r.id: r.words for r in index.near_search(terms, within).collect()} == want


def test_searches_read_index_folders_only(index):
    for found in (index.phrase_search("the river"), index.near_search(["the", "river"], 3)):
        plan = plan_of(found).split("== Physical Plan ==")[1]
        scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
        assert scans and all("positions" in line and "PartitionFilters: [" in line and "bucket" in line for line in scans)
        assert "text:string" not in plan and "Python" not in plan


def test_wrong_questions_are_refused(index):
    for ask in (lambda: index.phrase_search("--"), lambda: index.phrase_search("a " * (index.span + 1)),
                lambda: index.near_search(["a", "b"], 1), lambda: index.near_search(["a"], index.span + 1), lambda: index.near_search(["a b"], 3)):
        with pytest.raises(ValueError):
            ask()


def test_a_position_follows_the_tokens(spark):
    """Words are numbered as `tokens` finds them, whatever lies between."""
    df = spark.createDataFrame([(1, "A-b c_d É! 7x"), (2, ""), (3, None)], "id long, text string")
    want = df.where("id = 1").select(tokens(F.col("text"))).first()[0]
    rows = position_postings(df).withColumn("at", positions.places(positions.SPAN)).collect()
    assert sorted((r.at[0], r.term) for r in rows) == list(enumerate(want)) and {r.id for r in rows} == {1}


# --- blocks -------------------------------------------------------------------------------


def ranked(found):
    return [(r.id, r.score) for r in found.collect()]


def test_best_posts_by_blocks(spark, df, tmp_path):
    path = str(tmp_path / "blocks")
    write_blocks(postings(df), len(TEXTS), path, buckets=8, posts_a_block=10)
    index = read_blocks(spark, path)
    assert index.blocks == math.ceil(len(TEXTS) / 10)
    for terms, k in ((["the", "zebra"], 5), (["the"], 20), (WORDS, 400), (["rain", "w3", "w7"], 1), (["absent"], 3), (["absent", "the"], 2)):
        assert ranked(index.ranked_search(terms, k).best) == ranked(ranked_search(df, terms, k))


def test_blocks_of_a_stop_word_are_skipped(spark, tmp_path, monkeypatch):
    """Every post has the stop word; few have the other words, often."""
    monkeypatch.setattr("postflow.operators.block_index.FIRST", 2)
    rows = [(i, "the " * (1 + i % 3) + ("flood " * (5 + i % 7) if i % 97 == 0 else "") + ("x" if i % 2 else "")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "blocks")
    write_blocks(postings(df), len(rows), path, buckets=4, posts_a_block=10)
    index = read_blocks(spark, path)
    found = index.ranked_search(["the", "flood", "x"], 5)
    assert ranked(found.best) == ranked(ranked_search(df, ["the", "flood", "x"], 5))
    assert found.blocks == 300 and found.read < 60
    assert index.ranked_search(["absent"], 5).read == 0


REPEATED = [(1, "rain rain the"), (1, "the river"), (None, "rain"), (None, "rain 42 rain"), (2, "the rain"), (3, None), (4, ""), (5, "ÜBER über x")]


def test_repeated_ids_are_one_post(spark):
    rows = spark.createDataFrame(REPEATED, "id long, text string").repartition(4)
    want = collections.Counter((w, i) for i, text in REPEATED for w in words(text))
    assert {(r.term, r.id): r.tf for r in postings(rows).collect()} == want
    places = collections.defaultdict(set)
    for i, text in REPEATED:
        for p, w in enumerate(words(text)):
            places[w, i].add(p)
    got = position_postings(rows, span=2).withColumn("at", positions.places(2)).collect()
    found = collections.defaultdict(set)
    for r in got:
        assert not found[r.term, r.id] & set(r.at) and all(p // 2 == r.block for p in r.at)
        found[r.term, r.id] |= set(r.at)
    assert found == places
    assert collections.Counter((r.term, r.id) for r in got if r.first) == dict.fromkeys(places, 1)


@pytest.mark.parametrize("made", [postings, position_postings])
def test_postings_are_made_without_a_shuffle(spark, made):
    plan = made(spark.createDataFrame(TEXTS, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_tasks_that_sort_an_index_grow_with_the_texts(spark, df, conf, monkeypatch, tmp_path):
    from postflow.operators import text_index

    assert text_index.index_tasks(df) is None
    size = sum(len(t.encode()) for _, t in TEXTS if t)
    monkeypatch.setattr(text_index, "TASK_BYTES", size // 20)
    tasks = text_index.index_tasks(df)
    assert tasks in (20, 21) and text_index.by_range(postings(df), ["term"], tasks).rdd.getNumPartitions() == tasks
    write_positions(position_postings(df), str(tmp_path), buckets=8, tasks=tasks)
    stored = read_positions(spark, str(tmp_path))
    want = sum("the" in words(t) for _, t in TEXTS)
    assert stored.counts(["the"]).collect()[0]["df"] == want
