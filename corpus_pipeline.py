"""From raw documents to packed training sequences.

Every stage takes all that its predecessor kept, written as Parquet and read again. All but the
last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflow.llm import jaccard, language, packing, quality
from postflow.llm.queries import mixture
from postflow.llm.support import on_path, read, settle, unused

LEAST_QUALITY = 0.3
LEAST_CERTAINTY = 0.5
MIXTURE_SHARE = 0.9  # of the tokens that arrive


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labels, is at least 0.3; null and empty texts are scored too."""
    on_path(spark)
    forest = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(forest)(F.col("text")) >= LEAST_QUALITY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: as likely as all others together, and no costlier than its own texts by far.

    The first alone is true of almost any text, so the second is what sends foreign text and noise
    away, unless it is so short (about 40 bytes) that it could be a name or a key. Texts without a
    letter go.
    """
    on_path(spark)
    model, limits = language.fit_limits(docs)
    name, = unused(docs, "language")
    judged = docs.withColumn(name, language.language_of(spark, model)(F.col("text")))
    certain = (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_CERTAINTY)
    near = language.keeps_limit(F.col(name), F.col("text"), limits)
    return judged.where(certain & near).drop(name)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id, once; one without an id only if none has one.

    Rows are told apart by a hash of id and text, so that rows without an id and different texts
    under one id are documents of their own. Wordless texts are near nothing.
    """
    on_path(spark)
    row, stays = unused(docs, "row", "stays")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    narrow = rows.select(F.col(row).alias("row"), "doc_id", "text")
    found = jaccard.jaccard_components(narrow.select("row", "text"), key="row").select("row", "component_id").distinct()
    ids = narrow.select("row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    stay = found.join(ids, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(stays))
    kept = rows.join(stay, F.col(row) == F.col(stays)).dropDuplicates([row])
    return kept.drop(row, stays)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token-prefix of every domain, language and source, by target weights; no document twice."""
    on_path(spark)
    name, = unused(docs, "copies")
    return mixture(docs, share=MIXTURE_SHARE, max_epochs=1, name=name).where(F.col(name) > 0).drop(name)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place in it; null text is empty."""
    on_path(spark)
    return packing.pack_pieces(packing.cut_documents(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", best_fit_packing),
]

# Trained models and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
