"""Tables written to the cluster's shared folder to cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without such a setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    folder = tempfile.mkdtemp(prefix="postflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/postflow/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write `df` once and read it back.

    The result survives lost executors, never recomputes its inputs, and carries the size of
    its files, so Spark broadcasts it in a join only when it is in fact small. The folder is
    left for the owner of the shared folder to expire, as with reliable checkpoints.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _files(spark: SparkSession, path: str):
    """Spark's own file system for `path`, and the path in its form."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `new_folder` that nothing needs any more."""
    files, place = _files(spark, path)
    files.delete(place, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted; none if its folder does not exist."""
    files, place = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(place) or [])


def mark(spark: SparkSession, path: str) -> tuple:
    """Bytes, number of files and time of change of a stored table; differs once files were added or replaced."""
    files, place = _files(spark, path)
    summary = files.getContentSummary(place)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(place).getModificationTime()
