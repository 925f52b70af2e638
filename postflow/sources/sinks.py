"""Where envelopes, processed posts and rejects go."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from postflow.schema import PROCESSED
from postflow.staging import matching


def write_envelopes(
    values: DataFrame, format: str, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Append the `value` column of a stream to a topic, or to text files."""
    writer = (
        values.select("value")
        .writeStream.format(format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .options(**options)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def query_id(df: DataFrame) -> str:
    """Inside a micro-batch: the id that its query keeps as long as its checkpoint; else `none`."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def envelope_files(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches of envelopes to text files; a replayed batch replaces itself."""

    def write(values: DataFrame, batch_id: int) -> None:
        values.write.mode("overwrite").text(f"{path}/query={query_id(values)}/batch_id={batch_id}")

    return write


def envelope_topic(format: str, **options) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches of envelopes to a topic, with its settings from the caller.

    A topic can only be appended to, so a micro-batch that is replayed after a crash arrives again:
    at least once. Every record has a `key` of its query, its batch and its content, the same in a
    replay, by which `without_replays` or the topic's own compaction leaves out the second copy.
    """

    def write(values: DataFrame, batch_id: int) -> None:
        key = F.concat_ws("/", F.lit(query_id(values)), F.lit(str(batch_id)), F.sha2(F.col("value").cast("binary"), 256))
        values.select(key.alias("key"), "value").write.format(format).mode("append").options(**options).save()

    return write


def without_replays(records: DataFrame) -> DataFrame:
    """The `value` of each `(key, value)` record of a topic once, however often its micro-batch was replayed.

    Equal envelopes of one micro-batch are one post and count once, too. On a stream, set a watermark
    ahead: keys are kept as long as it allows.
    """
    return records.dropDuplicates(["key"]).select("value")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store one micro-batch of a query under both their ids; a replayed batch replaces itself.

    A query keeps its id as long as its checkpoint, so another checkpoint never overwrites what
    is there.
    """
    df.write.mode("overwrite").parquet(f"{path}/query={query_id(df)}/batch_id={batch_id}")


def write_batch_to_store(df: DataFrame, format: str, **options) -> None:
    """Append one micro-batch through a connector, with its settings from the caller.

    Replays are safe only where the connector upserts on a key: pass its option for `id`.
    """
    df.write.format(format).mode("append").options(**options).save()


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the micro-batches whose write has ended."""
    done = matching(spark, f"{path}/query=*/batch_id=*/_SUCCESS")
    return [d.rpartition("/")[0] for d in done]


def read_batches(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """Stored micro-batches with their `query` and `batch_id`: all committed ones, or those in `folders`."""
    schema = T.StructType([
        *PROCESSED.fields, T.StructField("query", T.StringType()), T.StructField("batch_id", T.LongType())
    ])
    found = committed(spark, path) if folders is None else folders
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found)
