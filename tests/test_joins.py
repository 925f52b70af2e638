"""Dense index, replay join, lookup join and hot keys."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from conftest import plan_of
from postflow.operators import joins
from postflow.operators.dense_index import dense_index
from postflow.operators.joins import enrich_join, hot_keys, replay_join, split_join


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=60), st.integers(1, 6))
def test_index_equals_the_global_window(spark, counts, parts):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "id long, retweet_count long").repartition(parts)
    got = dense_index(df, ["retweet_count", "id"], partitions=parts)
    want = df.withColumn("index", F.row_number().over(Window.orderBy("retweet_count", "id")) - 1)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_nulls_come_first_and_descending_works(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id long, n long")
    assert [r.id for r in dense_index(df, ["n"]).orderBy("index").collect()] == [2, 3, 1]
    assert [r.id for r in dense_index(df, [F.desc("n")]).orderBy("index").collect()] == [1, 3, 2]


def test_copies_spread_over_tasks(spark):
    """A third of the rows are equal in every column; they still go to several tasks."""
    df = spark.range(0, 30_000, 1, 24).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("n"))
    index = dense_index(df, ["n"], partitions=8)
    rows = [r["index"] for r in index.collect()]
    assert sorted(rows) == list(range(30_000))
    spread = df.withColumn("_origin", F.spark_partition_id()).repartitionByRange(8, "n", "_origin")
    tasks = spread.where("n = 7").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 2
    assert max(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()) < 30_000 / 4


def test_index_plan_has_no_single_partition_over_rows(spark):
    df = spark.range(1000).withColumn("n", F.col("id") % 7)
    plan = plan_of(dense_index(df, ["n", "id"]))
    physical = plan[plan.index("== Physical Plan =="):]
    for line in physical.split("\n"):
        if "SinglePartition" in line:
            # only the offsets, one row per task, come together
            below = physical[physical.index(line):]
            assert "HashAggregate" in below.split("\n")[1]


def test_replay_picks_one_post_per_tick(spark):
    indexed = dense_index(spark.range(10).withColumn("n", -F.col("id")), ["n"])
    ticks = spark.range(25).select(F.col("id").alias("value"))
    got = replay_join(ticks, indexed).orderBy("index").collect()
    assert [(r["index"], r.id) for r in got] == [(i, 9 - i) for i in range(10)]


def test_lookup_needs_a_unique_dimension(spark):
    facts = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (None, "m")], "k long, v string")
    assert sorted(tuple(r) for r in enrich_join(facts, dim, "k").collect()) == [(1, "a"), (2, "b"), (2, "b")]
    assert enrich_join(facts, dim, "k", "left").count() == 4
    with pytest.raises(ValueError, match="more than once"):
        enrich_join(facts, dim.union(dim), "k")


def test_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert hot_keys(df, "k", at_least=100) == ["hot"]
    assert hot_keys(df, "k") == []
    assert hot_keys(df.where("k is null"), "k", at_least=0) == []
    assert hot_keys(df, "k", share=0.5, at_least=100) == []


def counting(spark, df):
    """`df` with a column that counts how often its rows are computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(_):
        seen.add(1)
        return 0

    return df.withColumn("touched", touch.asNondeterministic()(F.lit(0))), seen


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_the_plain_join(spark, conf, how):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(5)
    keys = [rng.choice([1, 1, 1, None, rng.randrange(50)]) for _ in range(2000)]
    facts = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(12)
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(40)], "k long, v string")
    plain = facts.join(dim, "k", how)
    for hot in ([], [1], [1, 2, 99]):
        for size in (0, 1 << 20):
            split = split_join(facts, dim, "k", hot, how, hot_bytes=size)
            assert split.columns == plain.columns
            assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))


def spread(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_a_hot_key_spreads_even_after_a_shuffle_on_it(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    facts = spark.range(0, 24_000, 1, 24).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(1).alias("k"))
    shuffled = facts.repartition(8, "k")
    dim = spark.range(0, 24_000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert spread(shuffled.where("k = 1")) == 1
    assert spread(enrich_join(shuffled, dim, "k", hot_rows=1000).where("k = 1")) >= 4
    assert enrich_join(shuffled, dim, "k", hot_rows=1000).count() == 24_000


def test_repeated_ticks_spread(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    indexed = dense_index(spark.range(50).withColumn("n", -F.col("id")), ["n"])
    ticks = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 60).alias("value")).repartition(8, "value")
    got = replay_join(ticks, indexed, hot_rows=1000)
    assert spread(got.where("index = 7")) >= 4
    assert got.count() == ticks.where("value < 50").count()


def test_inputs_are_computed_at_most_twice(spark):
    facts = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(4000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    for hot_rows in (100, 100_000):
        counted, seen = counting(spark, facts)
        enrich_join(counted, dim, "k", hot_rows=hot_rows).write.format("noop").mode("overwrite").save()
        assert 0 < seen.value <= 2 * 4000


def test_index_computes_its_input_once(spark, tmp_path):
    counted, seen = counting(spark, spark.range(0, 1000, 1, 4).withColumn("n", F.col("id") % 7))
    path = str(tmp_path / "index")
    dense_index(counted, ["n", "id"], path=path).write.format("noop").mode("overwrite").save()
    assert seen.value == 1000
    assert spark.read.parquet(path).count() == 1000


def test_join_kinds(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        joins.split_join(df, df, "k", [], "outer")
