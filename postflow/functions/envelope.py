"""The JSON envelope that carries a post through a topic."""

from pyspark.sql import Column, DataFrame, functions as F

from postflow.schema import ENVELOPE

UTC = {"timeZone": "UTC"}


def encode(df: DataFrame) -> DataFrame:
    """All columns as one JSON string per row, in a `value` column."""
    return df.select(F.to_json(F.struct("*"), UTC).alias("value"))


def decode(df: DataFrame, schema=ENVELOPE, keep_json: bool = False) -> DataFrame:
    """The fields of the JSON in `value` (string or binary) as columns.

    Bad JSON gives a row of nulls, a bad field gives null in that field.
    """
    parsed = df.select(F.col("value").cast("string").alias("json")).select(
        "json", F.from_json("json", schema).alias("data")
    )
    return parsed.select(*(["json"] if keep_json else []), "data.*")


def accepted(decoded: DataFrame, schema=ENVELOPE) -> DataFrame:
    """Rows of `decode(..., keep_json=True)` with at least one field."""
    return decoded.where(_some_field(schema)).drop("json")


def rejected(decoded: DataFrame, schema=ENVELOPE) -> DataFrame:
    """The raw JSON of rows without any field."""
    return decoded.where(~_some_field(schema)).select("json")


def _some_field(schema) -> Column:
    found = F.lit(False)
    for name in schema.fieldNames():
        found = found | F.col(name).isNotNull()
    return found


def restore_time(df: DataFrame) -> DataFrame:
    """`created_at` as a timestamp again; text that is none becomes null."""
    return df.withColumn("created_at", F.col("created_at").try_cast("timestamp"))


def iso_time(instant: Column) -> Column:
    """A timestamp as the envelope writes it."""
    in_json = F.to_json(F.struct(instant.alias("t")), UTC)
    return F.get_json_object(in_json, "$.t")
