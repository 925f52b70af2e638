"""Every registered query against its SQL, and what its plan must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_oracle import duck, normal
from conftest import plan_of
from postflow.plans import catalog
from postflow.staging import shared_dir

SF = "/root/testdata/sf0.001"
# The queries of the other subpackage have their own tests.
OWN = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_queries_have_sql():
    assert set(OWN) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    plan = plan_of(df)
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoop"):
        assert word not in plan
    got = df.toPandas()
    want = con.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert normal(got) == normal(want)


def test_entry(spark):
    assert contract.entry(spark).count() == 200


def test_results_do_not_depend_on_the_session_zone(spark, con, conf):
    conf("spark.sql.session.timeZone", "America/Denver")
    for name in ("parse_time", "json_scan", "envelope_roundtrip", "sentiment_by_day", "compat_columns"):
        got = contract.queries()[name](spark, SF).toPandas()
        assert normal(got) == normal(con.execute(contract.oracle_sql()[name]).df())


def test_only_needed_columns_are_read(spark):
    plan = plan_of(catalog.post_coordinates(spark, SF)).split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text" not in plan
    plan = plan_of(catalog.bbox_search(spark, SF)).split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<id:bigint,lat:double,lon:double>" in plan
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat" in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_the_lexicon_stays_out_of_the_plan(spark):
    """Both queries join it; no term is a constant."""
    for name in ("sentiment_score", "sentiment_lexicon"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        assert "worthless" not in plan and "from_json" not in plan


def test_searches_with_an_index_read_few_folders(spark):
    plan = plan_of(catalog.combined_search_indexed(spark, SF)).split("== Physical Plan ==")[1]
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    ranked = plan_of(catalog.index_ranked_search(spark, SF)).split("== Physical Plan ==")[1]
    assert "sentiment_score" not in ranked and "cleaned_text" not in ranked


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    for name in ("documents", "events", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(20).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, first = str(tmp_path / "documents.parquet"), catalog.processed_table(spark, str(tmp_path)).count()
    assert first == catalog.processed_table(spark, str(tmp_path)).count() == 20
    spark.read.parquet(docs).limit(1).withColumn("doc_id", F.lit(10**9).cast("long")).write.mode("append").parquet(docs)
    assert catalog.processed_table(spark, str(tmp_path)).count() == 21  # its event is missing, it is not
    assert catalog.text_index(spark, str(tmp_path)).posts == 21
