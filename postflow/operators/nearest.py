"""The posts nearest to each of many places, by cells of the curve."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflow.functions.curve import LEVELS, cell_at, cell_corner, curve_key
from postflow.functions.geo import EARTH_KM, distance_between
from postflow.staging import stage

STEP = 4  # levels at once: a cell is cut into 256
SLACK = 1e-8  # radians, a few centimetres: far above what rounding does to a distance
KM_DIGITS = 6


def nearest_posts(posts: DataFrame, centers: DataFrame, k: int, digits: int = KM_DIGITS) -> DataFrame:
    """`(center_id, rank, id, distance_km)`: for each center the `k` nearest posts, its own id left out; all, if fewer.

    Distances are rounded to `digits` decimals of a kilometre, and equal ones come in order of
    their ids. Posts and centers without both coordinates take no part, nor do posts without an id;
    ids of centers are taken to be unique, and a repeated row of a post is one post.

    Every center starts with one cell, the globe. In each round its cells are replaced by the
    cells inside them that hold posts. Numbers of posts tell within which distance `k` others lie
    for certain, and cells that begin beyond it are dropped: the ring that is left closes in. The
    last cells are a few metres wide, and only their posts are measured. Posts of one place, be they
    a third of all, count as its `k + 1` smallest ids, and centers of one place search once.
    """
    located = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("id").isNotNull())
    smallest = Window.partitionBy("lat", "lon").orderBy("id")
    first = (
        located(posts).select("id", "lat", "lon").distinct()
        .withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    )
    places = stage(
        first.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("curve", curve_key(F.col("lat"), F.col("lon"))),
        "places",
    )
    asked = stage(located(centers).select(F.col("id").alias("center_id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "centers")
    frontier = asked.select("lat0", "lon0").distinct().withColumn("cell", F.lit(0).cast("bigint"))
    # Cells with their numbers of posts, from the finest level up: each is made of the one below.
    counts = {LEVELS: stage(places.groupBy(F.col("curve").alias("cell")).agg(F.sum(F.size("ids")).alias("n")), "cells")}
    for level in range(LEVELS - STEP, 0, -STEP):
        finer = counts[level + STEP].groupBy(F.shiftright("cell", 2 * STEP).alias("cell")).agg(F.sum("n").alias("n"))
        counts[level] = stage(finer, "cells")
    for level in range(STEP, LEVELS + 1, STEP):
        inner = counts[level].select(F.shiftright("cell", 2 * STEP).alias("outer"), F.col("cell").alias("inner"), "n")
        cut = frontier.join(inner, F.col("cell") == F.col("outer")).select("lat0", "lon0", F.col("inner").alias("cell"), "n")
        frontier = stage(_closed_in(cut, level, k + 1), "frontier")
    near = frontier.join(places, F.col("cell") == cell_at(F.col("curve"), LEVELS))
    distance = F.round(distance_between(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")), digits)
    best = Window.partitionBy("lat0", "lon0").orderBy("distance_km", "id")
    # One more than is wanted, as a center may be among its own posts.
    found = (
        near.select("lat0", "lon0", distance.alias("distance_km"), F.explode("ids").alias("id"))
        .withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        .groupBy("lat0", "lon0").agg(F.sort_array(F.collect_list(F.struct("distance_km", "id"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda p: p["id"] != F.col("center_id")), 1, k)
    answers = asked.join(found, ["lat0", "lon0"]).select("center_id", F.posexplode(others).alias("at", "post"))
    return answers.select("center_id", (F.col("at") + 1).alias("rank"), "post.id", "post.distance_km")


def _closed_in(frontier: DataFrame, level: int, wanted: int) -> DataFrame:
    """`(lat0, lon0, cell)` of the cells that may hold one of the `wanted` nearest posts of their center."""
    least, most = _reach(level)
    measured = frontier.select("*", least.alias("least"), most.alias("most"))
    center = Window.partitionBy("lat0", "lon0")
    upto = center.orderBy("most").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The first cells, by where they end, that hold enough posts together bound the wanted distance.
    summed = measured.withColumn("posts", F.sum("n").over(upto))
    bound = F.coalesce(F.min(F.when(F.col("posts") >= wanted, F.col("most"))).over(center), F.lit(math.inf))
    return summed.withColumn("bound", bound).where(F.col("least") <= F.col("bound")).select("lat0", "lon0", "cell")


def _reach(level: int) -> tuple[Column, Column]:
    """Bounds, in radians, of the distances between a center and the points of a cell of `level`."""
    south, west, height, width = cell_corner(F.col("cell"), level)
    lat0, lon0 = F.col("lat0"), F.col("lon0")
    lat_gap = F.radians(F.greatest(F.lit(0.0), south - lat0, lat0 - (south + height)))
    # Around the globe from the cell's middle, less half its width.
    turn = F.abs(F.pmod(lon0 - (west + width / 2) + 180.0, F.lit(360.0)) - 180.0)
    lon_gap = F.radians(F.greatest(F.lit(0.0), turn - width / 2))
    # No point at that angle or more is nearer than the meridian there, or than the pole.
    to_meridian = F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat0)) * F.sin(F.least(lon_gap, F.lit(math.pi / 2)))))
    least = F.greatest(lat_gap, to_meridian) - SLACK
    # To the middle, and from there along a parallel and a meridian.
    middle = distance_between(south + height / 2, west + width / 2, lat0, lon0) / EARTH_KM
    flattest = F.greatest(F.lit(0.0), south, -(south + height))
    half = math.radians(height / 2) + math.radians(width / 2) * F.cos(F.radians(flattest))
    return least, middle + half + SLACK
