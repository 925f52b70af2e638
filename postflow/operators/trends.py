"""Hashtags with a large share of a window's uses, found by mergeable summaries and then counted."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow.sources.sinks import committed, write_batch

TRACKED = 8_192  # hashtags that a summary keeps at most, whatever the number of different ones
# A hashtag's count in a summary is too low by at most this share of the uses over TRACKED, and
# one that it names must be twice as far above.
LEAST_SHARE = 6.0


def _uses(posts: DataFrame, width: str) -> DataFrame:
    """`(bucket_start, hashtag)`: each hashtag of a post once, lowercased. Posts without a time have none."""
    tags = F.array_distinct(F.transform("hashtags", F.lower))
    bucket: Column = F.window("created_at", width).start
    return posts.where(F.col("created_at").isNotNull()).select(bucket.alias("bucket_start"), F.explode(tags).alias("hashtag")).where("hashtag is not null")


def summarize(posts: DataFrame, width: str, tracked: int = TRACKED) -> DataFrame:
    """`(bucket_start, summary, uses)` per window: the frequent hashtags, in bounded space, and the number of all uses.

    Summaries are merged on the way to the window's one row, so a window with a third of all posts
    costs each task one summary.
    """
    return _uses(posts, width).groupBy("bucket_start").agg(
        F.expr(f"approx_top_k_accumulate(hashtag, {int(tracked)})").alias("summary"), F.count("*").alias("uses")
    )


def run_summaries(
    posts: DataFrame, path: str, checkpoint: str, width: str, tracked: int = TRACKED, trigger: dict | None = None
) -> StreamingQuery:
    """Store the summaries of each micro-batch; a replayed one replaces itself."""
    writer = posts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    write = lambda batch, batch_id: write_batch(summarize(batch, width, tracked), path, batch_id)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(write).start()


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries of all finished micro-batches."""
    found = committed(spark, path)
    if not found:
        return spark.createDataFrame([], "bucket_start timestamp, hashtag string").groupBy("bucket_start").agg(
            F.expr("approx_top_k_accumulate(hashtag, 100)").alias("summary"), F.count("*").alias("uses")
        )
    return spark.read.parquet(*found)


def trending(summaries: DataFrame, posts: DataFrame, width: str, share: float, tracked: int = TRACKED) -> DataFrame:
    """`(bucket_start, hashtag, posts, uses)`: every hashtag with at least `share` of its window's uses, counted exactly.

    `summaries` are those of the same posts, of one batch or of many, with the same width and
    `tracked`. Merged, they name all hashtags above the share and few others, at most some 2 / share
    a window; only the uses of those are counted. A share too small for the summaries is refused.
    """
    if share * tracked < LEAST_SHARE:
        raise ValueError(f"share must be at least {LEAST_SHARE / tracked} for {tracked} tracked hashtags, got {share}")
    merged = summaries.groupBy("bucket_start").agg(
        F.expr(f"approx_top_k_combine(summary, {int(tracked)})").alias("summary"), F.sum("uses").alias("uses")
    )
    named = merged.select("bucket_start", "uses", F.explode(F.expr(f"approx_top_k_estimate(summary, {int(tracked)})")).alias("found"))
    # Estimates are never too low.
    candidates = named.where(F.col("found.count") >= F.col("uses") * share).select("bucket_start", "uses", F.col("found.item").alias("hashtag"))
    counted = _uses(posts, width).join(candidates, ["bucket_start", "hashtag"]).groupBy("bucket_start", "hashtag", "uses")
    return counted.agg(F.count("*").alias("posts")).where(F.col("posts") >= F.col("uses") * share).select(
        "bucket_start", "hashtag", "posts", "uses"
    )
