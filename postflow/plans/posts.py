"""The steps from a raw post to a processed one, for batch and stream alike."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from postflow.functions.envelope import iso_time
from postflow.functions.geo import lat_lon
from postflow.functions.score import sentiment_score
from postflow.functions.text import clean_text
from postflow.functions.times import parse_post_time
from postflow.operators.joins import enrich_join
from postflow.schema import ENVELOPE, PROCESSED

Labeller = Callable[[DataFrame], DataFrame]


def enrich(raw: DataFrame) -> DataFrame:
    """Raw posts to the columns of the envelope, with `created_at` as a timestamp.

    Hashtags are a projection of the post itself; joining the file to itself would give the
    same for unique ids and multiply repeated ones.
    """
    return raw.select(
        "id",
        parse_post_time(F.col("created_at")).alias("created_at"),
        F.col("geo.coordinates").alias("coordinates"),
        F.col("entities.hashtags.text").alias("hashtags"),
        clean_text(F.col("text")).alias("cleaned_text"),
    )


def enrich_by_lookup(raw: DataFrame, hashtags: DataFrame) -> DataFrame:
    """As `enrich`, with the hashtags looked up by `id` in a table of their own."""
    return enrich_join(enrich(raw).drop("hashtags"), hashtags, "id").select(ENVELOPE.fieldNames())


def process(enriched: DataFrame, label: Labeller, order: str = "lat,lon") -> DataFrame:
    """Enriched posts to processed ones; `label` adds `sentiment_result`."""
    lat, lon = lat_lon(F.col("coordinates"), order)
    labelled = label(enriched).withColumnRenamed("cleaned_text", "text")
    return labelled.select(
        "id",
        "created_at",
        "coordinates",
        lat.alias("lat"),
        lon.alias("lon"),
        "hashtags",
        "text",
        sentiment_score(F.col("sentiment_result")).alias("sentiment_score"),
    ).select(PROCESSED.fieldNames())


def annotation_labels(annotated: DataFrame, column: str = "sentiment") -> DataFrame:
    """For models that return annotations: `sentiment_result` out of an array of structs."""
    return annotated.withColumn("sentiment_result", F.col(f"{column}.result")).drop(column)


def compat_columns(processed: DataFrame) -> DataFrame:
    """The five-column form without key, with the time as the envelope writes it."""
    return processed.select(
        iso_time(F.col("created_at")).alias("created_at"),
        "coordinates",
        "hashtags",
        "text",
        "sentiment_score",
    )
