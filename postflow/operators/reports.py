"""Aggregates of processed posts by time, place and hashtag.

All aggregates combine before the shuffle, so one hot day, cell or hashtag costs each task one
row per group.
"""

from pyspark.sql import DataFrame, functions as F

from postflow.functions.geo import cell
from postflow.functions.times import utc_date


def time_histogram(df: DataFrame, width: str = "1 day") -> DataFrame:
    """Posts and mean score per tumbling bucket, aligned in UTC."""
    return (
        df.where(F.col("created_at").isNotNull())
        .groupBy(F.window("created_at", width).alias("bucket"))
        .agg(F.count("*").alias("posts"), F.avg("sentiment_score").alias("mean_score"))
        .select(
            F.col("bucket.start").alias("bucket_start"),
            F.col("bucket.end").alias("bucket_end"),
            "posts",
            "mean_score",
        )
    )


def grid_counts(df: DataFrame, degrees: float) -> DataFrame:
    """Posts and mean score per grid cell, for posts with a place."""
    return (
        df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(*cell(F.col("lat"), F.col("lon"), degrees))
        .agg(F.count("*").alias("posts"), F.avg("sentiment_score").alias("mean_score"))
    )


def hashtag_rows(df: DataFrame) -> DataFrame:
    """One row per post and distinct lowercase hashtag, in a `hashtag` column."""
    return df.withColumn("hashtag", F.explode(F.array_distinct(F.transform("hashtags", F.lower))))


def hashtag_counts(df: DataFrame, k: int | None = None) -> DataFrame:
    """Posts per hashtag, all or the `k` most frequent; ties by hashtag."""
    counts = hashtag_rows(df.select("hashtags")).groupBy("hashtag").agg(F.count("*").alias("posts"))
    return counts if k is None else counts.orderBy(F.desc("posts"), "hashtag").limit(k)


def sentiment_by(df: DataFrame, *keys) -> DataFrame:
    """Positive, neutral and negative posts and the mean score per group."""
    score = F.col("sentiment_score")
    return df.groupBy(*keys).agg(
        F.count_if(score > 0).alias("pos"),
        F.count_if(score == 0).alias("neutral"),
        F.count_if(score < 0).alias("neg"),
        F.avg(score).alias("mean_score"),
    )


def sentiment_by_hashtag(df: DataFrame) -> DataFrame:
    return sentiment_by(hashtag_rows(df.select("hashtags", "sentiment_score")), "hashtag")


def sentiment_by_day(df: DataFrame) -> DataFrame:
    return sentiment_by(df, utc_date(F.col("created_at")).alias("day"))


def sentiment_by_cell(df: DataFrame, degrees: float) -> DataFrame:
    placed = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return sentiment_by(placed, *cell(F.col("lat"), F.col("lon"), degrees))
