import pytest
from pyspark.sql import types as T

from postflow.llm.support import on_path

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for their own columns.
    T.StructField("_key", T.StringType()), T.StructField("score", T.StringType()), T.StructField("copies", T.StringType()),
    T.StructField("length", T.StringType()), T.StructField("id", T.StringType()), T.StructField("size", T.StringType()),
])

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards box with jumping quails near the river bank "


@pytest.fixture(autouse=True)
def importable(spark):
    on_path(spark)


@pytest.fixture
def documents(spark):
    """Make a table of documents from rows (doc_id, text, lang, source)."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), 1, "a", "b", "c", "d", "e", "f") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def odd_documents(documents):
    """Nulls, empty and very long texts, ties, and repeated rows."""
    return documents([
        (0, None, None, None), (1, "", "en", "src1"), (2, " \n\t", "en", "src1"), (3, "a", "en", "src0"),
        (4, SENTENCE * 12_000, "en", "src0"), (5, SENTENCE * 3, "en", "src0"), (6, SENTENCE * 3, None, "src2"),
        (6, SENTENCE * 3, None, "src2"), (7, "###### 12345 $$$", "en", None), (8, "d'été où l'œuvre 𝔘𝔫𝔦 <|endoftext|>", "fr", "src0"),
        (9, SENTENCE * 3 + "end", "en", "src0"), (10, "one two three four", "en", "src4"), (11, "one TWO\nthree  four", "en", "src4"),
    ])
