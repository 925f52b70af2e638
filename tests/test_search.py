"""Searches, inverted index, reports and the date layout, against plain Python."""

import collections
import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.operators import reports, search
from postflow.operators.text_index import doc_counts, posts_with, postings, ranked_search, read_index, write_index
from postflow.schema import PROCESSED
from postflow.sources.layout import compact, read_layout, write_layout
from postflow.sources.sinks import read_batches, write_batch

UTC = dt.timezone.utc
WORDS = ["rain", "river", "road", "bridge", "über", "42", "the"]


def make_rows(n=400, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        at = dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=rng.randrange(60 * 24 * 4))
        placed = rng.random() < 0.8
        lat, lon = (rng.uniform(-90, 90), rng.uniform(-180, 180)) if placed else (None, None)
        tags = rng.choice([None, [], ["Storm"], ["storm", "STORM", "rain"], ["rain", None]])
        text = rng.choice([None, "", " ".join(rng.choice(WORDS).upper() if rng.random() < 0.3 else rng.choice(WORDS)
                                              for _ in range(rng.randrange(12)))])
        yield (i, at, [lat, lon] if placed else None, lat, lon, tags, text, rng.choice([1, 0, -1, None]))


ROWS = list(make_rows())


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, PROCESSED).repartition(4).cache()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def ids(found):
    return sorted(r.id for r in found.select("id").collect())


def test_text_search(df):
    for mode, test in (("any", any), ("all", all)):
        for terms in (["rain"], ["River", "the"], ["über", "42", "road"]):
            want = [r[0] for r in ROWS if test(t.lower() in words(r[6]) for t in terms)]
            assert ids(search.text_search(df, terms, mode)) == want
    with pytest.raises(ValueError):
        search.text_search(df, ["rain"], "some")


def test_time_range_is_half_open(df):
    start, end = ROWS[0][1], ROWS[0][1] + dt.timedelta(hours=30)
    assert ids(search.time_range(df, start, end)) == [r[0] for r in ROWS if start <= r[1] < end]
    assert ROWS[0][0] not in ids(search.time_range(df, start - dt.timedelta(hours=1), start))


def test_box_and_radius(df):
    inside = lambda r, s, w, n, e: r[3] is not None and s <= r[3] <= n and (
        w <= r[4] <= e if w <= e else r[4] >= w or r[4] <= e)
    for box in ((-20, -60, 50, 70), (-90, 150, 90, -120)):
        assert ids(search.box_search(df, *box)) == [r[0] for r in ROWS if inside(r, *box)]

    def km(r, lat0, lon0):
        a, b, c, d = map(math.radians, (r[3], r[4], lat0, lon0))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    for center, radius in (((0, 0), 4000), ((20, 179), 3000), ((85, 10), 2500)):
        want = [r[0] for r in ROWS if r[3] is not None and km(r, *center) <= radius]
        assert ids(search.radius_search(df, *center, radius)) == want


def test_hashtags(df):
    has = lambda r, tag: tag in [t.lower() for t in r[5] or [] if t]
    for asked in ("storm", "#Storm", "RAIN"):
        assert ids(search.hashtag_search(df, asked)) == [r[0] for r in ROWS if has(r, asked.lower().lstrip("#"))]
    counts = collections.Counter(t for r in ROWS for t in {t.lower() if t else None for t in r[5] or []})
    assert {r.hashtag: r.posts for r in reports.hashtag_counts(df).collect()} == counts
    assert [r.hashtag for r in reports.hashtag_counts(df.where("id >= 0"), 1).collect()] == [
        max(counts, key=lambda t: counts[t])]


def test_postings_and_index_search(spark, df, tmp_path):
    tf = collections.Counter((w, r[0]) for r in ROWS for w in words(r[6]))
    rows = postings(df)
    assert {(r.term, r.id): r.tf for r in rows.collect()} == tf
    in_posts = collections.Counter(t for t, _ in tf)
    assert {r.term: r.df for r in doc_counts(rows).collect()} == in_posts
    path = str(tmp_path / "index")
    write_index(rows, len(ROWS), path, buckets=8)
    index = read_index(spark, path)  # which knows its bucket count
    assert (index.buckets, index.posts) == (8, len(ROWS))
    assert {(r.term, r.id): r.tf for r in index.postings().collect()} == tf
    assert {r.term: r.df for r in index.counts().collect()} == in_posts
    terms = ["rain", "the"]
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(index.postings(terms)) or "PartitionFilters: [bucket" in plan_of(index.postings(terms))
    for mode, test in (("any", any), ("all", all)):
        want = [r[0] for r in ROWS if test((t, r[0]) in tf for t in terms)]
        assert ids(index.posts_with(terms, mode)) == want
        assert ids(search.text_search(df, terms, mode, index=index)) == want
        with_box = dict(terms=terms, mode=mode, box=(-45, -90, 45, 90))
        assert ids(search.combined_search(df, **with_box, index=index)) == ids(search.combined_search(df, **with_box))
    for mode in ("ALL", "some"):
        with pytest.raises(ValueError):
            posts_with(rows, terms, mode)
    score = {
        r[0]: round(sum(tf[t, r[0]] * math.log((len(ROWS) + 1) / (in_posts[t] + 1)) for t in terms), 6)
        for r in ROWS if any((t, r[0]) in tf for t in terms)
    }
    want = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:20]
    assert [tuple(r) for r in ranked_search(df, terms, 20).collect()] == want
    assert [tuple(r) for r in index.ranked_search(terms, 20).collect()] == want


def test_ranked_search_without_hits(df):
    assert ranked_search(df, ["absent"], 5).collect() == []


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_histogram(df):
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[1].replace(minute=0, hour=r[1].hour // 6 * 6)].append(r[7])
    got = reports.time_histogram(df, "6 hours").select(F.unix_seconds("bucket_start").alias("s"), "posts", "mean_score").collect()
    assert {r.s: r.posts for r in got} == {int(k.timestamp()): len(v) for k, v in groups.items()}
    assert all(close(r.mean_score, mean(groups[dt.datetime.fromtimestamp(r.s, UTC)])) for r in got)


def test_grid_and_sentiment(df):
    groups = collections.defaultdict(list)
    for r in ROWS:
        if r[3] is not None:
            groups[math.floor(r[3] / 30), math.floor(r[4] / 30)].append(r[7])
    got = reports.grid_counts(df, 30.0).collect()
    assert {(r.cell_lat, r.cell_lon): r.posts for r in got} == {k: len(v) for k, v in groups.items()}
    for r in reports.sentiment_by_cell(df, 30.0).collect():
        scores = groups[r.cell_lat, r.cell_lon]
        assert (r.pos, r.neutral, r.neg) == (scores.count(1), scores.count(0), scores.count(-1))
        assert close(r.mean_score, mean(scores))
    days = {str(r.day): r.pos + r.neutral + r.neg for r in reports.sentiment_by_day(df).collect()}
    assert days == collections.Counter(str(r[1].date()) for r in ROWS if r[7] is not None)
    tags = {r.hashtag: r.pos for r in reports.sentiment_by_hashtag(df).collect()}
    assert tags["storm"] == sum(r[7] == 1 and "storm" in [t.lower() for t in r[5] or [] if t] for r in ROWS)


def test_layout_prunes_days(spark, df, tmp_path):
    path = str(tmp_path / "layout")
    write_layout(df, path, degrees=10.0)
    stored = read_layout(spark, path)
    assert sorted(map(repr, stored.select(PROCESSED.fieldNames()).collect())) == sorted(map(repr, df.collect()))
    between = ("2024-01-02T00:00:00", "2024-01-03T00:00:00")
    plan = plan_of(search.time_range(stored, *between))
    physical = plan[plan.index("== Physical Plan =="):]
    assert "PartitionFilters: [isnotnull(created_date" in physical
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in physical
    box = (-45, -90, 45, 90)
    args = dict(terms=["rain"], between=between, box=box)
    found = search.combined_search(stored, **args)
    assert "PartitionFilters: [isnotnull(created_date" in plan_of(found)
    assert ids(found) == ids(search.combined_search(df, **args))
    assert ids(search.combined_search(stored)) == ids(df)
    days = search.time_range(stored, *between).select("created_date").distinct().collect()
    assert [str(r[0]) for r in days] == ["2024-01-02"]


def test_layout_splits_a_hot_day(spark, conf, tmp_path):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep small tasks apart
    day = dt.datetime(2024, 1, 1, tzinfo=UTC)
    copies = spark.range(0, 4000, 1, 16).select(
        F.lit(1).cast("long").alias("id"), F.lit(day).alias("created_at"),
        F.lit(None).cast("array<double>").alias("coordinates"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
        F.lit(None).cast("array<string>").alias("hashtags"), F.lit("x").alias("text"), F.lit(1).alias("sentiment_score"))
    path = str(tmp_path / "hot")
    write_layout(copies, path)
    stored = read_layout(spark, path)
    assert stored.count() == 4000
    assert len(stored.inputFiles()) >= 2


def test_layout_computes_its_input_once(spark, df, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(score):
        seen.add(1)
        return score

    write_layout(df.withColumn("sentiment_score", touch.asNondeterministic()("sentiment_score")), str(tmp_path / "layout"))
    assert seen.value == len(ROWS)


def test_a_corrected_day_replaces_the_old_one(spark, df, tmp_path):
    path = str(tmp_path / "layout")
    one = df.where("id = 0")
    write_layout(one, path)
    write_layout(one.withColumn("created_at", F.col("created_at") + F.expr("interval 9 days")), path)
    assert ids(read_layout(spark, path)) == [0]


def stored(df, batches, *numbers):
    for n in numbers:
        write_batch(df.where(F.col("id") % 3 == n), batches, n)


def test_compaction_repeats_safely(spark, df, tmp_path):
    batches, path = str(tmp_path / "batches"), str(tmp_path / "table")
    stored(df, batches, 0, 1, 2, 1)  # a replay replaces itself
    assert read_batches(spark, batches).count() == len(ROWS)
    assert compact(spark, batches, path, 0, 1) == "0-1"
    assert compact(spark, batches, path, 2) == "2-2"
    assert compact(spark, batches, path, 0, 1) == "0-1"
    assert compact(spark, batches, path, 3) is None
    assert ids(read_layout(spark, path)) == [r[0] for r in ROWS]


def test_overlapping_compaction_is_refused(spark, df, tmp_path):
    batches, path = str(tmp_path / "batches"), str(tmp_path / "table")
    stored(df, batches, 0, 1)
    compact(spark, batches, path, 0, 0)
    with pytest.raises(ValueError, match="overlap"):
        compact(spark, batches, path, 0, 1)
    compact(spark, batches, path, 1)
    assert ids(read_layout(spark, path)) == [r[0] for r in ROWS if r[0] % 3 < 2]


def test_unfinished_batches_are_not_read(spark, df, tmp_path):
    batches = tmp_path / "batches"
    stored(df, str(batches), 0, 1)
    (batches / "query=none" / "batch_id=1" / "_SUCCESS").unlink()
    assert ids(read_batches(spark, str(batches))) == [r[0] for r in ROWS if r[0] % 3 == 0]
    compact(spark, str(batches), str(tmp_path / "table"))
    assert ids(read_layout(spark, str(tmp_path / "table"))) == [r[0] for r in ROWS if r[0] % 3 == 0]


def test_a_post_sent_twice_is_stored_once(spark, df, tmp_path):
    batches, path = str(tmp_path / "batches"), str(tmp_path / "table")
    some = df.where("id < 20")
    write_batch(some.unionByName(some), batches, 0)
    write_batch(some.where("id < 5").withColumn("text", F.lit("newer")), batches, 1)
    write_batch(some.where("id < 9").unionByName(df.where("id between 30 and 33")), batches, 2)
    write_batch(some.limit(2).withColumn("id", F.lit(None).cast("long")), batches, 3)
    compact(spark, batches, path, 0, 1)
    rows = {r.id: r.text for r in read_layout(spark, path).collect()}
    assert sorted(rows) == list(range(20)) and {rows[i] for i in range(5)} == {"newer"}
    compact(spark, batches, path, 2)
    known = read_layout(spark, path)
    assert ids(known.where("id is not null")) == [*range(20), *range(30, 34)] and known.where("id is null").count() == 2


def test_runs_without_common_ids_are_not_read(spark, df, tmp_path, monkeypatch):
    from postflow.sources import layout

    batches, path = str(tmp_path / "batches"), str(tmp_path / "table")
    read = []
    real = layout._stored_ids
    monkeypatch.setattr(layout, "_stored_ids", lambda spark, path, folders: read.append(folders) or real(spark, path, folders))
    # Batches 0 to 2 hold every third id, so their ranges overlap; 3 repeats some of batch 1.
    stored(df, batches, 0, 1, 2)
    write_batch(df.where("id % 30 = 1").unionByName(df.where("id = 5").withColumn("id", F.lit(10**6).cast("long"))), batches, 3)
    for n in range(3):
        compact(spark, batches, path, n, n)
    assert read == []
    compact(spark, batches, path, 3, 3)
    assert read == [["1-1.2"]]
    assert ids(read_layout(spark, path)) == [*[r[0] for r in ROWS], 10**6]


def test_half_written_runs_are_invisible(spark, df, tmp_path):
    import shutil

    batches, path = str(tmp_path / "batches"), tmp_path / "table"
    stored(df, batches, 0, 1)
    compact(spark, batches, str(path), 0, 0)
    # A run that broke off: its files are there, its manifest is not.
    shutil.copytree(path / "run=0-0.1", path / "run=1-1.2")
    (path / "manifest" / "version=2").mkdir()
    want = [r[0] for r in ROWS if r[0] % 3 == 0]
    assert ids(read_layout(spark, str(path))) == want
    compact(spark, batches, str(path), 1)
    assert ids(read_layout(spark, str(path))) == [r[0] for r in ROWS if r[0] % 3 < 2]
    assert read_layout(spark, str(tmp_path / "nothing")).count() == 0


def test_bloom_filter(spark):
    from postflow.operators.bloom import blocks_for, build_filter, may_hold

    ids = spark.range(0, 40_000, 2).union(spark.createDataFrame([(None,), (-5,)], "id long"))
    blocks = blocks_for(20_000)
    held = build_filter(ids, blocks)
    assert held.count() <= blocks
    asked = spark.range(-100, 40_000).unionByName(spark.createDataFrame([(None,)], "id long"))
    found = {r.id for r in may_hold(asked, held, blocks).collect()}
    assert found >= {*range(0, 40_000, 2), -5} and None not in found
    assert len(found) - 20_001 < 5
    assert may_hold(asked, build_filter(ids.where("false"), 1), 1).count() == 0
