"""Windows per hashtag over a stream, kept in the state store until the watermark has passed them."""

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow.sources.sinks import committed, query_id, write_batch
from postflow.staging import matching

_WINDOWS = "hashtag string, start timestamp, end timestamp, posts bigint, mean_score double"


def split_late(
    posts: DataFrame, path: str, late_path: str, checkpoint: str, lateness: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store a stream's posts in time, and apart from them the late ones, which windows behind it would drop in silence.

    Late is what is older than the newest post of all earlier micro-batches by more than
    `lateness`, a number of seconds, minutes, hours or days as text, or has no time. The
    folder in time is the input of `run_windows` with the same or a longer lateness, which then
    finds nothing late. A micro-batch that was stored is not written again, so its files keep
    their names for the reader behind.
    """
    allowed = _seconds(lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, query = batch.sparkSession, query_id(batch)
        newest = f"{path}-newest/query={query}"
        if matching(spark, f"{newest}/batch_id={batch_id}/_SUCCESS"):
            return
        earlier = [int(re.search(r"batch_id=(\d+)/", p)[1]) for p in matching(spark, f"{newest}/batch_id=*/_SUCCESS")]
        last = None
        if earlier:
            last = spark.read.schema("newest timestamp").parquet(f"{newest}/batch_id={max(earlier)}").first()["newest"]
        kept = batch.persist()
        try:
            in_time = F.col("created_at").isNotNull()
            if last is not None:
                in_time = in_time & (F.col("created_at") >= F.lit(last) - F.expr(f"interval {allowed} seconds"))
            write_batch(kept.where(F.coalesce(in_time, F.lit(False))), path, batch_id)
            write_batch(kept.where(~F.coalesce(in_time, F.lit(False))), late_path, batch_id)
            # Written last: with it the micro-batch is done.
            top = kept.agg(F.greatest(F.max("created_at"), F.lit(last).cast("timestamp")).alias("newest"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{newest}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    writer = posts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(write).start()


def stream_in_time(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """The posts that `split_late` stored in time, as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{path}/query=*/batch_id=*")


def sessions(gap: str) -> Column:
    """Posts of a hashtag that follow each other within `gap`."""
    return F.session_window("created_at", gap)


def sliding(width: str, slide: str) -> Column:
    """Windows of `width`, one beginning every `slide`."""
    return F.window("created_at", width, slide)


def run_windows(
    posts: DataFrame, window: Column, path: str, checkpoint: str, lateness: str, trigger: dict | None = None
) -> StreamingQuery:
    """Counts and mean scores per hashtag, lowercased, and `window`; one row for each, once it is closed.

    The state store holds the open windows only. A window is closed, stored and forgotten when the
    newest post is `lateness` beyond its end, so posts may arrive in any order within that time. The
    stream can stop and go on from its checkpoint at any point; a replayed micro-batch replaces
    itself.
    """
    tags = F.array_distinct(F.transform("hashtags", F.lower))
    # The watermark comes first: posts without a hashtag move it, too.
    tagged = posts.withWatermark("created_at", lateness).select("created_at", "sentiment_score", F.explode(tags).alias("hashtag"))
    counted = (
        tagged.where(F.col("hashtag").isNotNull())
        .groupBy(window.alias("window"), "hashtag")
        .agg(F.count("*").alias("posts"), F.avg("sentiment_score").alias("mean_score"))
        .select("hashtag", "window.start", "window.end", "posts", "mean_score")
    )
    writer = counted.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id)).start()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """`(hashtag, start, end, posts, mean_score)` of all closed windows."""
    found = committed(spark, path)
    return spark.read.schema(_WINDOWS).parquet(*found) if found else spark.createDataFrame([], _WINDOWS)


def read_late(spark: SparkSession, path: str, schema) -> DataFrame:
    """The late posts of all finished micro-batches."""
    found = committed(spark, path)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _seconds(text: str) -> int:
    found = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", text)
    if not found:
        raise ValueError(f"a number of seconds, minutes, hours or days is wanted, got {text!r}")
    return int(dt.timedelta(**{found[2] + "s": int(found[1])}).total_seconds())
