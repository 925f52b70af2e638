"""Columns of the tables with the names that operators use inside change nothing and stay as they are."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postflow.llm.queries import QUERIES
from postflow.llm.support import read
from llm_fixtures import importable  # noqa: F401

SF = "/root/testdata/sf0.001"
HERE = pathlib.Path(corpus_pipeline.__file__).parent
SOURCES = [corpus_pipeline.__file__, *sorted(map(str, (HERE / "postflow" / "llm").glob("*.py")))]
FOUND = {n for f in SOURCES for n in re.findall(r"(?:alias|withColumn|withColumnRenamed|unused)\((?:\w+, )?\"(\w+)\"", pathlib.Path(f).read_text())}
NAMES = sorted({n.lower(): n for n in FOUND | {"_level_0", "_level_1", "_level_2", "_level_0_w", "stays", "part", "n", "g", "h"}}.values())


def cluttered(df):
    own = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("mine").alias(n) for n in NAMES if n.lower() not in own])


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("names")
    for name in ("documents", "embeddings", "labels", "conversations"):
        df = read(spark, SF, name).limit(120)
        df.write.parquet(str(folder / "plain" / f"{name}.parquet"))
        cluttered(df).write.parquet(str(folder / "cluttered" / f"{name}.parquet"))
    return str(folder / "plain"), str(folder / "cluttered")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_names_are_found():
    assert {"_level_0", "_epochs", "_last", "row", "language", "_part", "_key"} <= set(NAMES) and len(NAMES) > 80


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, folders, name):
    assert rows(QUERIES[name](spark, folders[1])) == rows(QUERIES[name](spark, folders[0]))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, folders, stage):
    plain, full = (stage(spark, read(spark, f, "documents"), f) for f in folders)
    given = read(spark, folders[1], "documents")
    assert full.columns == given.columns
    assert rows(full.select(*plain.columns)) == rows(plain)
    extra = [c for c in given.columns if c not in plain.columns]
    assert {v for r in full.select(*extra).collect() for v in r} == {"mine"}
