"""Zero-based dense index over a total order, without a single-partition window."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflow.staging import discard, new_folder

# monotonically_increasing_id keeps the task in the bits above these, the row below.
ROW_BITS = 33


def dense_index(
    df: DataFrame, order_by: list[str | Column], name: str = "index", partitions: int | None = None,
    path: str | None = None, stored: bool = False,
) -> DataFrame:
    """`df` with `name` running 0..n-1 in the order of `order_by` (nulls first when ascending).

    One range shuffle sorts the rows; each task numbers its own rows, and the number of rows in
    the tasks before it (one small row per task) is added. The input is written ahead, as finding
    the ranges reads it, too, unless it is a projection of `stored` files that stay; and the numbered rows are written before they are counted, so both
    uses see the same placement: to `path` if given, which the caller then owns.

    Rows equal in all of `order_by` may be many. The task a row came from is the last range
    key, which lets such a group spread over several tasks. It depends only on the row's place
    in its input partition's set, not on the order of arrival, so a retried task sends its rows
    to the same place.
    """
    order = [*order_by, F.col("_origin")]
    spark = df.sparkSession
    ahead = new_folder(spark, "index-input")
    if not stored:
        df.write.parquet(ahead)
    source = (df if stored else spark.read.schema(df.schema).parquet(ahead)).withColumn("_origin", F.spark_partition_id())
    ranged = (
        source.repartitionByRange(partitions, *order)
        if partitions
        else source.repartitionByRange(*order)
    )
    slotted = (
        ranged.sortWithinPartitions(*order).drop("_origin").withColumn("_slot", F.monotonically_increasing_id())
    )
    target = path or new_folder(spark, "dense-index")
    slotted.write.mode("overwrite").parquet(target)
    if not stored:
        discard(spark, ahead)
    numbered = spark.read.schema(slotted.schema).parquet(target)
    task = F.shiftright("_slot", ROW_BITS).cast("int")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(task.alias("_task"))
        .agg(F.count("*").alias("_rows"))
        .select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    row = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row per writing task: a size set by the cluster, not by the data.
    return (
        numbered.withColumn("_task", task)
        .join(F.broadcast(offsets), "_task")
        .withColumn(name, row + F.col("_offset"))
        .drop("_task", "_slot", "_offset")
    )
