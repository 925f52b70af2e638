"""Combined searches by bitmaps, against the search over all posts."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.operators import bitmaps, search
from postflow.operators.bitmaps import hit_ranges, read_bitmaps, write_bitmaps
from postflow.schema import PROCESSED
from test_search import make_rows

SEARCHES = [
    dict(terms=["rain", "the"], mode="all", between=("2024-01-02T03:00:00", "2024-01-03T00:00:00"), box=(-45, -90, 45, 90)),
    dict(terms=["rain", "über"], mode="any", box=(-60, 150, 60, -120)), dict(between=("2024-01-01T00:00:00", "2024-01-02T00:00:00")),
    dict(terms=["river"], mode="all"), dict(terms=["absent"]), dict(box=(10, 10, 10, 10)), dict(), dict(terms=["rain", "rain", "42"], mode="all"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(make_rows(900, 3)), PROCESSED).repartition(4).cache()


@pytest.fixture(scope="module", params=[4, 4096])
def index(request, spark, df, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bitmaps"))
    write_bitmaps(df, path, term_buckets=request.param)
    return read_bitmaps(spark, path)


def ids(found):
    return sorted(r.id for r in found.select("id").collect())


@pytest.mark.parametrize("asked", SEARCHES)
def test_same_posts_as_without(df, index, asked):
    found = index.combined_search(**asked)
    assert found.columns == df.columns
    assert ids(found) == ids(search.combined_search(df, **asked))


def test_candidates_are_few_and_hold_all(df, index):
    asked = SEARCHES[0]
    near = index.candidates(**asked)
    want = ids(search.combined_search(df, **asked))
    assert set(want) <= set(ids(index.posts().join(near, "ordinal")))
    if index.term_buckets > 1000:
        assert near.count() < 3 * len(want) + 20
    with pytest.raises(ValueError):
        index.candidates(["rain"], "some")


def test_only_row_groups_with_a_hit_are_read(spark, conf, tmp_path, monkeypatch):
    monkeypatch.setattr(bitmaps, "GRANULE", 16)
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", "40")
    conf("spark.sql.files.maxPartitionBytes", "1k")  # a file each
    conf("spark.sql.files.openCostInBytes", "1k")
    rows = spark.createDataFrame(list(make_rows(2000, 6)), PROCESSED)
    marked = rows.withColumn("text", F.when(F.col("id") % 500 == 7, "zebra").otherwise(F.col("text")))
    path = str(tmp_path / "bitmaps")
    write_bitmaps(marked, path)
    index = read_bitmaps(spark, path)
    found = index.combined_search(terms=["zebra"])
    assert ids(found) == ids(marked.where("text = 'zebra'")) and len(ids(found)) == 4
    ranges = hit_ranges(index.candidates(terms=["zebra"]))
    read = total = 0
    for file in glob.glob(f"{path}/posts/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            at = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}["ordinal"]
            total += 1
            read += any(a <= at.max and b >= at.min for a, b in ranges)
    assert total >= 30 and read <= 2 * 4
    conf("spark.sql.maxMetadataStringLength", "10000")
    assert "(ordinal," in plan_of(found).split("PushedFilters")[-1]


def test_many_hits_are_one_range(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "RANGES", 3)
    many = spark.range(0, 20_000, 3_000).withColumnRenamed("id", "ordinal")
    assert hit_ranges(many) == [(0, 18 * 1024 - 1)] and hit_ranges(many.where("ordinal > 15000")) == [(17 * 1024, 18 * 1024 - 1)]
    assert hit_ranges(many.where("false")) == []


def test_bits_of_words_are_set_post_by_post():
    """No row per word: a task holds one table of bits, also where numbers go back to an earlier part."""
    posts = [(5, [0, 3]), (32_767, [3]), (32_768, [1]), (70_000, []), (70_001, [3, 2]), (6, [3])]
    batches = [pa.RecordBatch.from_pydict({
        "ordinal": pa.array([n for n, _ in some], pa.int64()), "buckets": pa.array([b for _, b in some], pa.list_(pa.int32()))
    }) for some in (posts[:3], posts[3:])]
    found = set()
    for made in bitmaps.term_bitmaps(4, iter(batches)):
        for row in made.to_pylist():
            assert len(row["bits"]) == 4_096
            found |= {((row["part"] - 1) * 32_768 + at * 8 + bit, int(row["value"]))
                      for at, byte in enumerate(row["bits"]) for bit in range(8) if byte >> bit & 1}
    assert found == {(n, b) for n, some in posts for b in some}


def test_words_over_several_parts(spark, tmp_path):
    text = F.concat(F.lit("the w"), F.col("id") % 7, F.when(F.col("id") % 40_000 == 9, " zebra").otherwise(""))
    posts = spark.range(0, 70_000, 1, 3).select("id", F.timestamp_seconds(F.col("id")).alias("created_at"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), text.alias("text"))
    write_bitmaps(posts, str(tmp_path / "bitmaps"))
    index = read_bitmaps(spark, str(tmp_path / "bitmaps"))
    hits = index.posts().join(index.candidates(terms=["zebra", "the"], mode="all"), "ordinal")
    assert ids(hits) == [9, 40_009]
    assert index.candidates(terms=["w3"]).count() == 10_000
