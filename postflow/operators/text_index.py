"""Inverted index and ranked search."""

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postflow.functions.text import has_terms, normal_terms, tokens, word_counts
from postflow.operators.joins import split_repeated
from postflow.staging import stage

BUCKETS = 256
TASK_BYTES = 8 << 20  # text whose postings one task sorts, some 200 MB of rows with positions


def postings(df: DataFrame, text: str = "text") -> DataFrame:
    """One row `(term, id, tf)` per term of each post.

    Repeats inside a post are combined in its row, so what a task holds is bounded by its longest
    post and nothing is shuffled. Only rows whose id repeats meet in a shuffle, as they are one
    post; no term is ever gathered in one row.
    """
    counted = lambda rows: rows.select("id", F.inline(word_counts(F.col(text)))).select("term", "id", "tf")
    once, repeated = split_repeated(df.select("id", text), "id")
    if repeated is None:
        return counted(once)
    return counted(once).unionByName(counted(repeated).groupBy("term", "id").agg(F.sum("tf").alias("tf")))


def doc_counts(posting_rows: DataFrame) -> DataFrame:
    """`(term, df)`: the number of posts with each term."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"))


def index_tasks(texts: DataFrame, text: str = "text") -> int | None:
    """How many tasks sort the postings of `texts`, so that each one sorts those of `TASK_BYTES` of text; None for Spark's own number if that is enough."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = -(-size // TASK_BYTES)
    return tasks if tasks > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def by_range(df: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Range-partitioned on `order` and sorted inside the partitions."""
    dealt = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def write_index(posting_rows: DataFrame, posts: int, path: str, buckets: int = BUCKETS, tasks: int | None = None) -> None:
    """Store postings in folders by term bucket, the document counts likewise, and what reading needs.

    The rows are range-partitioned on `(bucket, term, id)`, so a term that fills a third of the
    index is written by a third of the tasks, of which `index_tasks` has a number that grows with
    the texts. `posts` is the number of indexed posts. The bucket count and it are written last: an
    index without them is unfinished.
    """
    spark = posting_rows.sparkSession
    order = ["bucket", "term", "id"]
    (
        by_range(posting_rows.withColumn("bucket", term_bucket(F.col("term"), buckets)), order, tasks)
        .write.partitionBy("bucket")
        .mode("overwrite")
        .parquet(f"{path}/postings")
    )
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    counts = stored.groupBy("term", "bucket").agg(F.count("*").alias("df"))
    counts.repartitionByRange("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/counts")
    about = spark.createDataFrame([(buckets, posts)], "buckets int, posts bigint")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


_POSTINGS = "term string, id bigint, tf bigint, bucket int"


@dataclass(frozen=True)
class TextIndex:
    """A stored index; reading terms touches only their folders."""

    spark: SparkSession
    path: str
    buckets: int
    posts: int

    def postings(self, terms=None) -> DataFrame:
        return self._rows("postings", _POSTINGS, terms).select("term", "id", "tf")

    def counts(self, terms=None) -> DataFrame:
        return self._rows("counts", "term string, df bigint, bucket int", terms).select("term", "df")

    def posts_with(self, terms, mode: str = "any") -> DataFrame:
        return posts_with(self.postings(terms), terms, mode)

    def ranked_search(self, terms, k: int) -> DataFrame:
        return ranked_search_stored(self.postings(terms), self.counts(terms), self.posts, terms, k)

    def _rows(self, folder: str, schema: str, terms) -> DataFrame:
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        if terms is None:
            return stored
        wanted = normal_terms(terms)
        folders = [term_bucket(F.lit(t), self.buckets) for t in wanted]
        return stored.where(F.col("bucket").isin(*folders) & F.col("term").isin(wanted))


def read_index(spark: SparkSession, path: str) -> TextIndex:
    """An index as `write_index` left it, with the bucket count it was written with."""
    about = spark.read.parquet(f"{path}/about").first()
    return TextIndex(spark, path, about["buckets"], about["posts"])


def posts_with(posting_rows: DataFrame, terms, mode: str = "any") -> DataFrame:
    """Ids of posts with any, or all, of the terms, from postings."""
    if mode not in ("any", "all"):
        raise ValueError(f"mode must be 'any' or 'all', got {mode!r}")
    wanted = normal_terms(terms)
    per_post = posting_rows.where(F.col("term").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
    return per_post.where(F.col("n") >= (len(wanted) if mode == "all" else 1)).select("id")


def ranked_search(df: DataFrame, terms, k: int, text: str = "text") -> DataFrame:
    """The `k` best posts by sum over terms of tf * ln((N + 1) / (df + 1)); ties by id.

    Works on the posts directly. One column per term holds its count in each post that has any;
    these few numbers are written once, so the text is read once although both the document
    counts and the scores need them.
    """
    wanted = normal_terms(terms)
    words = F.col("_tokens")
    counts = [f"_tf{i}" for i in range(len(wanted))]
    hits = stage(
        df.where(has_terms(F.col(text), wanted, every=False))
        .select("id", tokens(F.col(text)).alias("_tokens"))
        .select("id", *[_occurrences(words, t).alias(c) for t, c in zip(wanted, counts)])
        .groupBy("id")
        .agg(*[F.sum(c).alias(c) for c in counts]),
        "hits",
    )
    dfs = hits.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in counts]).first()
    total = df.count()
    weights = [idf(total, n) for n in dfs]
    score = functools.reduce(operator.add, [F.col(c) * w for c, w in zip(counts, weights)])
    return best_posts(hits.select("id", score.alias("score")), k)


def ranked_search_stored(
    posting_rows: DataFrame, term_counts: DataFrame, total: int, terms, k: int
) -> DataFrame:
    """As `ranked_search`, from postings and document counts; `total` is the number of posts."""
    wanted = normal_terms(terms)
    # At most one count per search term.
    dfs = {r.term: r.df for r in term_counts.where(F.col("term").isin(wanted)).collect()}
    weight = functools.reduce(
        lambda case, t: case.when(F.col("term") == t, idf(total, dfs.get(t, 0))), wanted, F.when(F.lit(False), 0.0)
    )
    scored = (
        posting_rows.where(F.col("term").isin(wanted))
        .groupBy("id")
        .agg(F.sum(F.col("tf") * weight).alias("score"))
    )
    return best_posts(scored, k)


def idf(total: int, posts: int) -> float:
    return math.log((total + 1) / (posts + 1))


def best_posts(scored: DataFrame, k: int) -> DataFrame:
    return (
        scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.asc("id")).limit(k)
    )


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
