"""Where posts, ticks and envelopes come from."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from postflow.functions.times import instant, instant_literal
from postflow.schema import POST


_BROKEN = "_broken"
_LINE = T.StructType([*POST.fields, T.StructField(_BROKEN, T.StringType())])


def parse_posts(lines: DataFrame) -> DataFrame:
    """Raw posts out of JSON lines in `value`, batch or stream; blank and malformed lines are left out.

    A line is malformed if it is not JSON, not an object, or a field is not of its declared type.
    """
    return _parsed(lines).where(~_malformed()).select("post.*").drop(_BROKEN)


def malformed_lines(lines: DataFrame) -> DataFrame:
    """The malformed lines themselves, in `line`; what `parse_posts` leaves out but blank lines."""
    return _parsed(lines).where(_malformed()).select(F.col("value").alias("line"))


def _parsed(lines: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    some = lines.where(F.trim("value") != "")
    return some.select("value", F.from_json("value", _LINE, options).alias("post"))


def _malformed() -> Column:
    return F.col("post").isNull() | F.col(f"post.{_BROKEN}").isNotNull()


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts from JSON lines; the declared schema saves the pass that would infer it."""
    return parse_posts(spark.read.text(path))


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_posts` has to leave out, for a table of rejects."""
    return malformed_lines(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of text files as they arrive, for `parse_posts` and `malformed_lines`."""
    return spark.readStream.options(**options).text(path)


def stream_posts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw posts from a folder of JSON files as they arrive."""
    return parse_posts(stream_lines(spark, path, **options))


def stream_ticks(spark: SparkSession, rows_per_second: int = 1, format: str = "rate", **options) -> DataFrame:
    """Ticks `(timestamp, value)` that drive a replay of indexed posts."""
    if format == "rate":
        options = {"rowsPerSecond": rows_per_second, **options}
    return spark.readStream.format(format).options(**options).load()


def read_envelopes(spark: SparkSession, format: str, stream: bool = True, start="earliest", **options) -> DataFrame:
    """The `value` column of a topic: `format="kafka"` with its package, or `"text"` files.

    `start` is where a reader without a checkpoint begins: `earliest`, the default, so that posts
    written before it starts are not missed, or a time (text with a zone, or in UTC, or a datetime),
    which leaves out what the topic had by then. Kafka also knows `latest`; for files that would mean another set
    after each restart, so a time is wanted instead. Options of the format go before it.
    """
    later = None
    if format == "kafka":
        given = {"startingOffsets": start} if start in ("earliest", "latest") else {"startingTimestamp": str(int(instant(start).timestamp() * 1000))}
        options = {**given, **options}
    elif start == "latest":
        raise ValueError("files have no latest position, give the time to start from")
    elif start != "earliest":
        later = F.col("_metadata.file_modification_time") > instant_literal(start)
    reader = spark.readStream if stream else spark.read
    found = reader.format(format).options(**options).load()
    return (found if later is None else found.where(later)).select(F.col("value"))
