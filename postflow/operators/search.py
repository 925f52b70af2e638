"""Searches over text, time, space and hashtags: filters that keep the rows they match."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from postflow.functions.curve import box_ranges, in_ranges
from postflow.functions.geo import box_around, distance_km, in_box
from postflow.functions.text import has_terms, normal_terms
from postflow.functions.times import instant, instant_literal
from postflow.operators.text_index import TextIndex


def text_search(df: DataFrame, terms, mode: str = "any", text: str = "text", index: TextIndex | None = None) -> DataFrame:
    """Rows whose tokens hold any, or all, of the terms.

    With an `index` of these posts their ids come from its postings, and no text is searched.
    """
    if mode not in ("any", "all"):
        raise ValueError(f"mode must be 'any' or 'all', got {mode!r}")
    if index is not None:
        return df.join(index.posts_with(terms, mode), "id", "left_semi").select(df.columns)
    return df.where(has_terms(F.col(text), normal_terms(terms), every=mode == "all"))


def time_range(df: DataFrame, start, end) -> DataFrame:
    """Rows with `created_at` in `[start, end)`; on the date layout only those dates are read."""
    wanted = df.where(
        (F.col("created_at") >= instant_literal(start)) & (F.col("created_at") < instant_literal(end))
    )
    if "created_date" not in df.columns:
        return wanted
    last = instant(end) - dt.timedelta(microseconds=1)
    return wanted.where(F.col("created_date").between(instant(start).date(), last.date()))


def box_search(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows inside a box, edges included; `west > east` crosses the 180th meridian."""
    return df.where(in_box(F.col("lat"), F.col("lon"), south, west, north, east))


def curve_box_search(df: DataFrame, south: float, west: float, north: float, east: float, ranges: int = 16) -> DataFrame:
    """As `box_search`, on a table with the places' `curve` keys: only row groups in the box's ranges of keys are read."""
    found = box_search(df, south, west, north, east)
    return found.where(in_ranges(F.col("curve"), box_ranges(south, west, north, east, ranges)))


def radius_search(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within `km` of a point, with their `distance_km`.

    The box around the circle is a plain range on stored columns, so it prunes the scan.
    """
    near = box_search(df, *box_around(lat, lon, km))
    return near.withColumn("distance_km", distance_km(F.col("lat"), F.col("lon"), lat, lon)).where(
        F.col("distance_km") <= km
    )


def hashtag_search(df: DataFrame, tag: str) -> DataFrame:
    """Rows with a hashtag, whatever its case."""
    lowered = F.transform("hashtags", F.lower)
    return df.where(F.array_contains(lowered, tag.lower().removeprefix("#")))


def combined_search(
    df: DataFrame, terms=None, mode: str = "any", between=None, box=None, text: str = "text",
    index: TextIndex | None = None,
) -> DataFrame:
    """Text, time and box searches in one; each is optional. Dates prune first, text comes last, by `index` if given."""
    found = df
    if between is not None:
        found = time_range(found, *between)
    if box is not None:
        found = box_search(found, *box)
    if terms is not None:
        found = text_search(found, terms, mode, text, index)
    return found
