"""Combined searches by bitmaps over the posts' ordinals, intersected before a post is read."""

import datetime as dt
import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postflow.functions.geo import cell
from postflow.functions.text import normal_terms, tokens
from postflow.functions.times import instant, utc_date
from postflow.operators import search
from postflow.operators.dense_index import dense_index
from postflow.operators.text_index import term_bucket
from postflow.staging import discard, new_folder, stage

TERM_BUCKETS = 4_096
CELL_DEGREES = 10.0
PART = 32_768  # posts of a bitmap, as Spark's bitmap functions have them
GRANULE = 1_024  # ordinals that are read together
RANGES = 500  # ranges of granules that a scan is told of; with more it is told their ends only


def write_bitmaps(
    posts: DataFrame, path: str, term_buckets: int = TERM_BUCKETS, degrees: float = CELL_DEGREES, stored: bool = False
) -> None:
    """Store posts `(id, created_at, lat, lon, text, ...)` in order of day and cell, numbered, and bitmaps of the numbers.

    There is a bitmap per bucket of terms, per day and per cell, for every 32,768 posts that it has
    any of. They are combined before the shuffle; those of terms, of which a post has many, as the
    posts are read in the order of their numbers, so that no row per word is made or sorted. What
    reading needs is written last. Posts of `stored` files that stay are not written ahead.
    """
    spark = posts.sparkSession
    lat_cell, lon_cell = cell(F.col("lat"), F.col("lon"), degrees)
    keyed = posts.select("*", utc_date(F.col("created_at")).alias("_day"), lat_cell.alias("_lat"), lon_cell.alias("_lon"))
    slots = new_folder(spark, "bitmap-input")
    numbered = dense_index(keyed, ["_day", "_lat", "_lon", "id"], "ordinal", path=slots, stored=stored)
    numbered.drop("_day", "_lat", "_lon").write.mode("overwrite").parquet(f"{path}/posts")
    # Bit positions count from 1.
    kinds = [
        F.struct(F.lit("day").alias("kind"), F.col("_day").cast("string").alias("value")),
        F.struct(F.lit("cell").alias("kind"), F.concat_ws("_", "_lat", "_lon").alias("value")),
    ]
    marks = numbered.select((F.col("ordinal") + 1).alias("at"), F.inline(F.array(*kinds))).where(F.col("value").isNotNull() & (F.col("value") != ""))
    few = marks.groupBy("kind", "value", F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    buckets = F.array_distinct(F.transform(tokens(F.col("text")), lambda t: term_bucket(t, term_buckets)))
    words = numbered.where(F.col("text").isNotNull()).select("ordinal", buckets.cast("array<int>").alias("buckets"))
    made = words.mapInArrow(functools.partial(term_bitmaps, term_buckets), "value string, part bigint, bits binary")
    terms = made.groupBy("value", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    maps = few.unionByName(terms.withColumn("kind", F.lit("term")))
    maps.repartitionByRange("kind", "value", "part").sortWithinPartitions("kind", "value", "part").write.partitionBy("kind").mode("overwrite").parquet(f"{path}/bitmaps")
    discard(spark, slots)
    about = spark.createDataFrame([(term_buckets, degrees)], "term_buckets int, degrees double")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def term_bitmaps(term_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(value, part, bits)` of posts `(ordinal, buckets)`, each with a bucket once; a part is held as one table of bits until another begins."""
    held, bits = None, np.zeros((term_buckets, PART // 8), np.uint8)

    def done() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(bits.any(axis=1))
        for at in range(0, len(some), 1_024):
            rows = some[at:at + 1_024]
            yield pa.RecordBatch.from_pydict({
                "value": [str(b) for b in rows], "part": pa.array(np.full(len(rows), held + 1)), "bits": [bits[b].tobytes() for b in rows]
            })

    for batch in batches:
        lists = batch.column("buckets")
        ordinals = np.repeat(batch.column("ordinal").to_numpy(), lists.value_lengths().to_numpy())
        buckets = lists.flatten().to_numpy()
        parts = ordinals // PART
        for part in np.unique(parts):
            if part != held:
                if held is not None:
                    yield from done()
                held = part
                bits[:] = 0
            at, bucket = ordinals[parts == part] % PART, buckets[parts == part]
            np.bitwise_or.at(bits, (bucket, at // 8), (1 << (at % 8)).astype(np.uint8))
    if held is not None:
        yield from done()


_BITMAPS = "value string, part bigint, bits binary, kind string"


@dataclass(frozen=True)
class BitmapIndex:
    spark: SparkSession
    path: str
    term_buckets: int
    degrees: float

    def candidates(self, terms=None, mode: str = "any", between=None, box=None) -> DataFrame:
        """`(ordinal)` of all posts that may match: bitmaps of each condition united, and those of all conditions intersected.

        Days, cells and buckets of terms are coarser than the conditions, so a few may not match.
        """
        asked = self._conditions(terms, mode, between, box)
        if not asked:
            return self.posts().select("ordinal")
        stored = self.spark.read.schema(_BITMAPS).parquet(f"{self.path}/bitmaps")
        united = None
        for number, (kind, test) in enumerate(asked):
            own = stored.where((F.col("kind") == kind) & test).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
            own = own.withColumn("condition", F.lit(number))
            united = own if united is None else united.unionByName(own)
        met = united.groupBy("part").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(asked))
        # Only bytes with a bit are taken apart.
        byte = F.conv(F.hex(F.col("byte")), 16, 10).cast("int")
        bytes_ = F.transform(F.sequence(F.lit(0), F.length("bits") - 1), lambda i: F.struct(i.alias("at"), F.substr("bits", i + 1, F.lit(1)).alias("byte")))
        some = met.select("part", F.inline(F.filter(bytes_, lambda b: b["byte"] != F.lit(b"\0"))))
        bits = some.select("part", "at", byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
        hit = F.call_function("shiftright", F.col("byte"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
        return bits.where(hit).select(((F.col("part") - 1) * 32_768 + F.col("at") * 8 + F.col("bit")).alias("ordinal"))

    def combined_search(self, terms=None, mode: str = "any", between=None, box=None) -> DataFrame:
        """As `search.combined_search` over the stored posts, which are read only where a candidate lies."""
        found = stage(self.candidates(terms, mode, between, box), "bitmap-hits")
        ranges = hit_ranges(found)
        posts = self.posts()
        if not ranges:
            return posts.where(F.lit(False)).drop("ordinal")
        near = functools.reduce(operator.or_, [F.col("ordinal").between(a, b) for a, b in ranges])
        held = posts.where(near).join(found, "ordinal", "left_semi").drop("ordinal")
        return search.combined_search(held, terms, mode, between, box)

    def posts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/posts")

    def _conditions(self, terms, mode: str, between, box) -> list[tuple[str, Column]]:
        value, out = F.col("value"), []
        if between is not None:
            first, last = instant(between[0]).date(), (instant(between[1]) - dt.timedelta(microseconds=1)).date()
            out.append(("day", value.between(str(first), str(last))))
        if box is not None:
            south, west, north, east = box
            place = F.split(value, "_")
            row, column = place[0].cast("bigint"), place[1].cast("bigint")
            at = lambda degrees: math.floor(degrees / self.degrees)
            across = column.between(at(west), at(east)) if west <= east else (column >= at(west)) | (column <= at(east))
            out.append(("cell", row.between(at(south), at(north)) & across))
        if terms is not None:
            if mode not in ("any", "all"):
                raise ValueError(f"mode must be 'any' or 'all', got {mode!r}")
            buckets = [term_bucket(F.lit(t), self.term_buckets).cast("string") for t in normal_terms(terms)]
            tests = [value.isin(*buckets)] if mode == "any" else [value == b for b in buckets]
            out += [("term", t) for t in tests]
        return out


def hit_ranges(found: DataFrame) -> list[tuple[int, int]]:
    """Ranges of ordinals, in whole granules, that hold all of `found`; one from the first to the last if there are more than `RANGES`."""
    granules = found.select(F.floor(F.col("ordinal") / GRANULE).alias("g")).distinct()
    some = sorted(r["g"] for r in granules.limit(RANGES + 1).collect())
    if not some:
        return []
    if len(some) > RANGES:
        ends = granules.agg(F.min("g").alias("low"), F.max("g").alias("high")).first()
        return [(ends["low"] * GRANULE, (ends["high"] + 1) * GRANULE - 1)]
    out = []
    for g in some:
        if out and out[-1][1] + 1 == g * GRANULE:
            out[-1] = (out[-1][0], (g + 1) * GRANULE - 1)
        else:
            out.append((g * GRANULE, (g + 1) * GRANULE - 1))
    return out


def read_bitmaps(spark: SparkSession, path: str) -> BitmapIndex:
    """An index as `write_bitmaps` left it."""
    about = spark.read.parquet(f"{path}/about").first()
    return BitmapIndex(spark, path, about["term_buckets"], about["degrees"])
