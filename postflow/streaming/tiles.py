"""Map tiles: a pyramid of counts and sums per grid cell, kept up to date by micro-batches."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow.functions.geo import cell
from postflow.staging import discard, matching

LEVELS = 3
_TILES = "level int, cell_lat bigint, cell_lon bigint, posts bigint, scored bigint, score_sum bigint, region string"


@dataclass(frozen=True)
class Pyramid:
    """Tiles of `degrees` per side at level 0, twice as large at each further one.

    Tiles are stored by region, a tile of the highest level with all tiles inside it. A micro-batch
    writes a new version of the regions it has posts in, and of no other. The version is there once
    all of it is written. Each version holds sums of all batches up to it, so reading needs only
    the last version of each region. One pyramid belongs to one query: its batch ids order the
    versions.
    """

    path: str
    degrees: float = 10.0
    levels: int = LEVELS

    def counts(self, posts: DataFrame) -> DataFrame:
        """The tiles of all levels over `posts`: combined on the finest level, then rolled up. Posts without a place have none."""
        lat, lon = cell(F.col("lat"), F.col("lon"), self.degrees)
        finest = (
            posts.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .groupBy(lat, lon)
            .agg(F.count("*").alias("posts"), F.count("sentiment_score").alias("scored"), F.coalesce(F.sum("sentiment_score"), F.lit(0)).alias("score_sum"))
        )
        up = lambda name, level: F.floor(F.col(name) / F.pow(F.lit(2.0), level))
        tiles = finest.withColumn("level", F.explode(F.array(*[F.lit(n) for n in range(self.levels)])))
        top = [up(c, F.lit(self.levels - 1)) for c in ("cell_lat", "cell_lon")]
        keyed = tiles.select(
            "level", up("cell_lat", F.col("level")).alias("cell_lat"), up("cell_lon", F.col("level")).alias("cell_lon"),
            "posts", "scored", "score_sum", F.concat_ws("_", *top).alias("region"),
        )
        return _summed(keyed)

    def add(self, posts: DataFrame, batch_id: int) -> list[str]:
        """Add a micro-batch and return the regions it touched. A replayed batch replaces itself.

        What is added to is the last version before this batch, so a replay finds the same. There
        are at most as many regions as tiles of the highest level on the globe.
        """
        spark = posts.sparkSession
        fresh = self.counts(posts).persist()
        try:
            touched = {r["region"] for r in fresh.select("region").distinct().collect()}
            before = {r: v for r, v in self._latest(spark, batch_id).items() if r in touched}
            merged = fresh
            if before:
                merged = _summed(fresh.unionByName(self._read(spark, before)))
            # A few rows a region: one file each.
            merged.repartition("region").write.partitionBy("region").mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        finally:
            fresh.unpersist()
        self._expire(spark, before, batch_id)
        return sorted(touched)

    def read(self, spark: SparkSession, level: int | None = None) -> DataFrame:
        """`(level, cell_lat, cell_lon, posts, mean_score)` over all finished micro-batches."""
        tiles = self._read(spark, self._latest(spark))
        if level is not None:
            tiles = tiles.where(F.col("level") == level)
        mean = F.col("score_sum") / F.nullif(F.col("scored"), F.lit(0))
        return tiles.select("level", "cell_lat", "cell_lon", "posts", mean.alias("mean_score"))

    def versions(self, spark: SparkSession) -> dict[str, int]:
        """The version of each region that a reader sees."""
        return self._latest(spark)

    def _versions(self, spark: SparkSession) -> list[tuple[int, str]]:
        done = {int(re.search(r"version=(\d+)", p)[1]) for p in matching(spark, f"{self.path}/version=*/_SUCCESS")}
        found = [re.search(r"version=(\d+)/region=([^/]+)$", p) for p in matching(spark, f"{self.path}/version=*/region=*")]
        return [(int(m[1]), m[2]) for m in found if int(m[1]) in done]

    def _latest(self, spark: SparkSession, before: int | None = None) -> dict[str, int]:
        latest: dict[str, int] = {}
        for version, region in sorted(self._versions(spark)):
            if before is None or version < before:
                latest[region] = version
        return latest

    def _read(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], _TILES)
        paths = [f"{self.path}/version={v}/region={r}" for r, v in versions.items()]
        return spark.read.schema(_TILES).option("basePath", self.path).parquet(*paths).select(*[c.split()[0] for c in _TILES.split(", ")])

    def _expire(self, spark: SparkSession, kept: dict[str, int], batch_id: int) -> None:
        """Delete what neither a reader nor a replay of this batch needs: versions older than the one added to."""
        for version, region in self._versions(spark):
            if version < kept.get(region, -1):
                discard(spark, f"{self.path}/version={version}/region={region}")


def _summed(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("level", "cell_lat", "cell_lon", "region").agg(
        *[F.sum(c).alias(c) for c in ("posts", "scored", "score_sum")]
    )


def run_tiles(processed: DataFrame, pyramid: Pyramid, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a pyramid up to date with a stream of processed posts."""
    writer = processed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(lambda batch, batch_id: pyramid.add(batch, batch_id)).start()
