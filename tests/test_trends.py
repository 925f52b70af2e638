"""Trending hashtags: exact above the share, in bounded space."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postflow.operators import trends

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "created_at timestamp, hashtags array<string>"


def rows(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        at = None if rng.random() < 0.05 else START + dt.timedelta(minutes=rng.randrange(48 * 60))
        tags = rng.choice([None, [], ["Rain"], ["rain", "RAIN", None], [f"t{rng.randrange(400)}"], [f"t{rng.randrange(6)}", "wind"]])
        yield at, tags


def brute(posts, share):
    counts = collections.defaultdict(collections.Counter)
    for at, tags in posts:
        if at is not None:
            bucket = int(at.timestamp()) // 21600 * 21600
            counts[bucket].update({t.lower() for t in tags or [] if t is not None})
    return {(b, t, n, sum(c.values())) for b, c in counts.items() for t, n in c.items() if n >= share * sum(c.values())}


def found(df):
    return {tuple(r) for r in df.select(F.unix_seconds("bucket_start"), "hashtag", "posts", "uses").collect()}


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5])
def test_exact_above_the_share_over_batches(spark, tmp_path, share):
    posts = list(rows(1500, 1))
    df = spark.createDataFrame(posts, SCHEMA)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    trends.run_summaries(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "6 hours", 1024, {"availableNow": True}).awaitTermination()
    stored = trends.read_summaries(spark, str(tmp_path / "out"))
    assert stored.select("bucket_start").distinct().count() < stored.count()  # several batches a window
    assert found(trends.trending(stored, df, "6 hours", share, 1024)) == brute(posts, share)


def test_a_million_hashtags_in_bounded_space(spark):
    tags = F.when(F.col("id") % 50 == 0, F.array(F.lit("hot"))).when(F.col("id") % 97 == 1, F.array(F.lit("warm"), F.concat(F.lit("x"), "id")))
    df = spark.range(0, 1_000_000, 1, 8).select(
        F.lit(START).alias("created_at"), tags.otherwise(F.array(F.concat(F.lit("u"), "id"))).alias("hashtags"))
    summary = trends.summarize(df, "6 hours", 2048)
    sizes = summary.select("uses", F.octet_length("summary.sketch").alias("size")).collect()
    assert len(sizes) == 1 and sizes[0]["size"] < 64 * 2048
    hot, warm = sum(i % 50 == 0 for i in range(10**6)), sum(i % 97 == 1 and i % 50 != 0 for i in range(10**6))
    uses = 10**6 + warm
    got = found(trends.trending(summary, df, "6 hours", 0.005, 2048))
    assert got == {(int(START.timestamp()), "hot", hot, uses), (int(START.timestamp()), "warm", warm, uses)}


def test_nothing_and_too_small_a_share(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert trends.read_summaries(spark, str(tmp_path)).count() == 0
    assert found(trends.trending(trends.summarize(none, "6 hours"), none, "6 hours", 0.1)) == set()
    with pytest.raises(ValueError):
        trends.trending(none, none, "6 hours", 0.0001, 1024)
