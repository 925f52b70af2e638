"""The streaming queries: ingest or replay, process, and the histogram.

Nothing here blocks: each function returns the running query and the caller awaits it.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow.functions.envelope import accepted, decode, encode, rejected, restore_time
from postflow.operators.joins import replay_join
from postflow.operators.lexicon import Labels
from postflow.plans.posts import Labeller, enrich, process
from postflow.sources.sinks import committed, write_batch, write_envelopes


def run_ingest(
    raw: DataFrame, format: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Enrich a stream of raw posts and write their envelopes."""
    return write_envelopes(encode(enrich(raw)), format, checkpoint, trigger, **options)


def run_replay(
    ticks: DataFrame,
    indexed: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Replay indexed posts, stored with their `index`, and write their envelopes.

    A stream joined to the table would read all of it in every micro-batch. Here each one first
    looks at the span of its ticks and reads only the row groups that hold those indexes.
    `write` takes the envelopes and the batch id, as `envelope_files` and `envelope_topic` do.
    """

    def replay(batch: DataFrame, batch_id: int) -> None:
        first, last = batch.agg(F.min("value"), F.max("value")).first()
        if first is not None:
            posts = indexed.where(F.col("index").between(first, last))
            write(encode(enrich(replay_join(batch, posts))), batch_id)

    writer = ticks.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(replay).start()


def run_process(
    envelopes: DataFrame,
    label: Labeller,
    path: str,
    rejects_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    store: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Decode, label, score and store envelopes; those without any field go to the rejects.

    Each micro-batch is an ordinary DataFrame, so `label` may join. `store` replaces the Parquet
    writer, for a connector.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch, keep_json=True).persist()
        try:
            posts = process(restore_time(accepted(decoded)), label)
            if store is None:
                write_batch(posts, path, batch_id)
            else:
                store(posts, batch_id)
            write_batch(rejected(decoded), rejects_path, batch_id)
        finally:
            decoded.unpersist()
            if isinstance(label, Labels):
                label.release(batch.sparkSession)

    writer = envelopes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(write).start()


def run_histogram(
    processed: DataFrame, path: str, checkpoint: str, width: str = "1 day", trigger: dict | None = None
) -> StreamingQuery:
    """Store each micro-batch's counts and sums per bucket; `read_histogram` adds them up.

    Exact whatever the order in which posts arrive or the input is cut into micro-batches: no post
    is late. A replayed batch replaces its own counts.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        partial = (
            batch.where(F.col("created_at").isNotNull())
            .groupBy(F.window("created_at", width).start.alias("bucket_start"))
            .agg(F.count("*").alias("posts"), F.count("sentiment_score").alias("scored"), F.sum("sentiment_score").alias("score_sum"))
        )
        write_batch(partial, path, batch_id)

    writer = processed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(count).start()


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """`(bucket_start, posts, mean_score)` over all committed micro-batches of `run_histogram`."""
    schema = "bucket_start timestamp, posts bigint, scored bigint, score_sum bigint"
    found = committed(spark, path)
    partial = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return partial.groupBy("bucket_start").agg(
        F.sum("posts").alias("posts"),
        (F.sum("score_sum") / F.nullif(F.sum("scored"), F.lit(0))).alias("mean_score"),
    )
