"""The query-ready layout: a folder per run and day, files sorted by place."""

import re
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postflow.functions.curve import curve_key
from postflow.functions.geo import cell
from postflow.functions.times import utc_date
from postflow.operators.bloom import WORDS, blocks_for, build_filter, may_hold
from postflow.schema import PROCESSED
from postflow.sources.sinks import committed, read_batches
from postflow.staging import discard, matching, new_folder, stage

CELL_DEGREES = 1.0
CLUSTERS = {"cell": ["cell_lat", "cell_lon"], "curve": ["curve"]}


def write_layout(
    processed: DataFrame, path: str, run: str = "all", degrees: float = CELL_DEGREES, cluster: str = "cell", stored: bool = False
) -> None:
    """Store processed posts by day, clustered by place inside the day.

    `cluster` names the order of places: `cell`, rows of cells from south to north, where a box
    reads the rows that it crosses, or `curve`, along the space-filling curve, where a box reads
    about its own share whatever its shape. Range partitioning on (day, place, id, input task)
    splits a day, a place, or even copies of one post over as many tasks as their share of the
    rows needs, so box searches skip files by their statistics. The posts are written once
    ahead, as finding the ranges reads them, too, unless they come from `stored` files that stay.
    A `run` that is repeated replaces all of its posts, whatever days they had before.
    """
    spark = processed.sparkSession
    if stored:
        _store(spark, processed.select(*PROCESSED.fieldNames()), path, run, degrees, cluster)
        return
    ahead = new_folder(spark, "layout-input")
    processed.select(*PROCESSED.fieldNames()).write.parquet(ahead)
    _store(spark, spark.read.schema(PROCESSED).parquet(ahead), path, run, degrees, cluster)
    discard(spark, ahead)


@dataclass(frozen=True)
class Run:
    """A stored run as the manifest has it: its folder, the number and the range of its ids, and the size of their filter."""

    name: str
    folder: str
    ids: int
    low: int | None
    high: int | None
    blocks: int


_RUN = "name string, folder string, ids bigint, low bigint, high bigint, blocks bigint"


def _store(spark: SparkSession, posts: DataFrame, path: str, run: str, degrees: float, cluster: str) -> None:
    """Write a run from posts that are cheap to read again, then the filter of its ids, and last a manifest that names it.

    A run that is repeated gets a new folder, so a reader sees either all of the old one or all of
    the new one.
    """
    if cluster not in CLUSTERS:
        raise ValueError(f"cluster must be one of {sorted(CLUSTERS)}, got {cluster!r}")
    version, runs = read_manifest(spark, path)
    version += 1
    folder = f"{run}.{version}"
    lat_cell, lon_cell = cell(F.col("lat"), F.col("lon"), degrees)
    keyed = posts.select(
        "*", utc_date(F.col("created_at")).alias("created_date"), lat_cell, lon_cell,
        curve_key(F.col("lat"), F.col("lon")).alias("curve"),
    ).withColumn("_origin", F.spark_partition_id())
    order = ["created_date", *CLUSTERS[cluster], "id", "_origin"]
    (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_origin")
        .write.partitionBy("created_date")
        .mode("overwrite")
        .parquet(f"{path}/run={folder}")
    )
    ids = posts.where(F.col("id").isNotNull()).select("id")
    about = ids.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    blocks = blocks_for(about["n"])
    build_filter(ids, blocks).write.mode("overwrite").parquet(f"{path}/filters/{folder}")
    stored = Run(run, folder, about["n"], about["low"], about["high"], blocks)
    kept = [r for r in runs if r.name != run]
    table = spark.createDataFrame([astuple(r) for r in [*kept, stored]], _RUN)
    table.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")
    for old in runs:
        if old.name == run:
            discard(spark, f"{path}/run={old.folder}")
            discard(spark, f"{path}/filters/{old.folder}")


def read_manifest(spark: SparkSession, path: str) -> tuple[int, list[Run]]:
    """The number of the last finished manifest, 0 if there is none, and the runs that it names."""
    done = [int(re.search(r"version=(\d+)/", p)[1]) for p in matching(spark, f"{path}/manifest/version=*/_SUCCESS")]
    if not done:
        return 0, []
    rows = spark.read.schema(_RUN).json(f"{path}/manifest/version={max(done)}").collect()  # a row a run
    return max(done), [Run(**r.asDict()) for r in rows]


def compact(spark: SparkSession, batches: str, path: str, first: int = 0, last: int | None = None) -> str | None:
    """Move the committed micro-batches `first..last`, or all from `first` on, into the layout.

    The run is named after the batches that were there; its name is returned, None if there were
    none. Repeating a run changes nothing, and one that overlaps another is an error. A post that
    arrived more than once, by its `id`, is stored once: as its last batch has it, and not again if
    an earlier run has it already. Posts without an id are all kept.
    """
    folders = {}
    for folder in committed(spark, batches):
        query, batch = folder.rsplit("/", 2)[1:]
        number = int(batch.partition("=")[2])
        if number >= first and (last is None or number <= last):
            folders.setdefault(number, []).append(folder)
    if not folders:
        return None
    run = f"{min(folders)}-{max(folders)}"
    others = [r for r in read_manifest(spark, path)[1] if r.name != run]
    for other in others:
        a, b = map(int, other.name.split("-"))
        if a <= max(folders) and b >= min(folders):
            raise ValueError(f"batches {run} overlap the stored run {other.name}")
    new = read_batches(spark, batches, [f for many in folders.values() for f in many])
    posts = stage(_once(new), "compact-input")
    known = _stored_already(posts, path, others)
    if known is not None:
        posts = stage(posts.join(known, "id", "left_anti"), "compact-new")
    _store(spark, posts, path, run, CELL_DEGREES, "cell")
    return run


def _stored_already(posts: DataFrame, path: str, runs: list[Run]) -> DataFrame | None:
    """The ids of `posts` that are in one of the runs; None if there is none for certain.

    Runs whose range of ids is apart are not looked at, and of the others first only the filters.
    Ids are read from those runs that may hold some, however many there are besides.
    """
    spark = posts.sparkSession
    ids = posts.where(F.col("id").isNotNull()).select("id")
    span = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    near = [r for r in runs if r.ids and span["low"] is not None and r.low <= span["high"] and r.high >= span["low"]]
    if not near:
        return None
    maybe = None
    for r in near:
        bloom = spark.read.schema(_FILTER).parquet(f"{path}/filters/{r.folder}")
        own = may_hold(ids.where(F.col("id").between(r.low, r.high)), bloom, r.blocks).withColumn("folder", F.lit(r.folder))
        maybe = own if maybe is None else maybe.unionByName(own)
    maybe = stage(maybe, "compact-maybe")
    found = [r["folder"] for r in maybe.select("folder").distinct().collect()]  # at most one a run
    if not found:
        return None
    return _stored_ids(spark, path, found).join(maybe.select("id").distinct(), "id", "left_semi").distinct()


def _stored_ids(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(*[f"{path}/run={f}" for f in folders]).select("id")


def _once(batches: DataFrame) -> DataFrame:
    """Every id once, from its last batch; rows without an id stay. Combined before the shuffle."""
    columns = PROCESSED.fieldNames()
    last = (
        batches.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("batch_id", "query", *columns)).alias("_last"))
        .select("_last.*")
    )
    return last.select(columns).unionByName(batches.where(F.col("id").isNull()).select(columns))


_SCHEMA = T.StructType([
    *PROCESSED.fields,
    T.StructField("cell_lat", T.LongType()),
    T.StructField("cell_lon", T.LongType()),
    T.StructField("curve", T.LongType()),
    T.StructField("run", T.StringType()),
    T.StructField("created_date", T.DateType()),
])


_FILTER = ", ".join(["block bigint", *[f"{w} bigint" for w in WORDS]])


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The posts of the runs that the last finished manifest names."""
    runs = read_manifest(spark, path)[1]
    if not runs:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(*[f"{path}/run={r.folder}" for r in runs])
