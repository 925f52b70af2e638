"""Ranked search that reads only the blocks of postings that can reach the best k."""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflow.functions.text import normal_terms
from postflow.operators.text_index import BUCKETS, best_posts, by_range, idf, term_bucket
from postflow.staging import stage

POSTS_A_BLOCK = 256
FIRST, GROWTH, MOST = 16, 4, 1_024  # blocks of the first round, and how many more each round takes
ROUNDING = 1e-6


def write_blocks(
    posting_rows: DataFrame, posts: int, path: str, buckets: int = BUCKETS, posts_a_block: int = POSTS_A_BLOCK, tasks: int | None = None
) -> None:
    """Store postings `(term, id, tf)` cut into blocks of posts, and the largest count of each term in each block.

    The blocks are the same for all terms, dealt by a hash of the id, so the largest counts of a
    block's terms bound the score of all its posts. A term's postings lie block by block, in
    pages of about a block of a frequent term, which a reader of few blocks skips. Range-partitioned,
    so a frequent term is written by many of the `tasks`. `posts` is the number of indexed posts.
    """
    spark = posting_rows.sparkSession
    blocks = max(1, -(-posts // posts_a_block))
    order = ["bucket", "term", "block", "id"]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    keyed = posting_rows.select("term", "id", "tf", term_bucket(F.col("term"), buckets).alias("bucket"), block.alias("block"))
    (
        by_range(keyed, order, tasks)
        .write.partitionBy("bucket")
        .option("parquet.page.row.count.limit", str(posts_a_block))
        .mode("overwrite")
        .parquet(f"{path}/postings")
    )
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    largest = stored.groupBy("bucket", "term", "block").agg(F.max("tf").alias("most"), F.count("*").alias("posts"))
    largest.repartitionByRange("bucket", "term", "block").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/largest")
    about = spark.createDataFrame([(buckets, blocks, posts)], "buckets int, blocks int, posts bigint")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


_POSTINGS = "term string, id bigint, tf bigint, block int, bucket int"
_LARGEST = "term string, block int, most bigint, posts bigint, bucket int"


@dataclass(frozen=True)
class Found:
    """The best posts, `(id, score)`, and how many of the blocks with any of the terms were read."""

    best: DataFrame
    read: int
    blocks: int


@dataclass(frozen=True)
class BlockIndex:
    spark: SparkSession
    path: str
    buckets: int
    blocks: int
    posts: int

    def ranked_search(self, terms, k: int) -> Found:
        """The `k` best posts by sum over terms of tf * ln((N + 1) / (df + 1)); ties by id.

        Blocks are read in rounds, those with the greatest bounds first. Once the next bound is
        below the k-th score, no block that is left can hold a better post. The driver sees the
        blocks of one round, never more than `MOST`.
        """
        wanted = normal_terms(terms)
        largest = self._rows("largest", _LARGEST, wanted)
        counts = largest.groupBy("term").agg(F.sum("posts").alias("df")).collect()  # at most one row a term
        weights = {r["term"]: idf(self.posts, r["df"]) for r in counts}
        weight = F.lit(0.0)
        for term, value in weights.items():
            weight = F.when(F.col("term") == term, F.lit(value)).otherwise(weight)
        bounds = stage(largest.groupBy("block").agg(F.sum(F.col("most") * weight).alias("bound")), "block-bounds")
        total, read, take, last, best, least = bounds.count(), 0, FIRST, None, None, -math.inf
        while True:
            rest = bounds if last is None else bounds.where(
                (F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("block") > last["block"]))
            )
            turn = rest.orderBy(F.desc("bound"), "block").limit(take).collect()
            chosen = [r["block"] for r in turn if r["bound"] >= least - ROUNDING]
            if chosen:
                read += len(chosen)
                scores = self._scores(wanted, chosen, weight)
                best = stage(best_posts(scores if best is None else best.unionByName(scores), k), "block-best")
                worst = best.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
                least = worst["score"] if worst["n"] == k else -math.inf
            if len(turn) < take or len(chosen) < len(turn):
                break
            last, take = turn[-1], min(take * GROWTH, MOST)
        if best is None:
            best = self.spark.createDataFrame([], "id bigint, score double")
        return Found(best, read, total)

    def _scores(self, wanted: list[str], blocks: list[int], weight) -> DataFrame:
        held = self._rows("postings", _POSTINGS, wanted).where(_among(blocks))
        return held.groupBy("id").agg(F.sum(F.col("tf") * weight).alias("score"))

    def _rows(self, folder: str, schema: str, wanted: list[str]) -> DataFrame:
        folders = [term_bucket(F.lit(t), self.buckets) for t in wanted]
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        return stored.where(F.col("bucket").isin(*folders) & F.col("term").isin(wanted))


def _among(blocks: list[int]):
    """`block` is one of these: a range for each run of them, which the reader tests against pages; a set for many."""
    blocks = sorted(blocks)
    heads = [b for b, before in zip(blocks, [None, *blocks]) if before is None or b != before + 1]
    tails = [b for b, after in zip(blocks, [*blocks[1:], None]) if after is None or b != after - 1]
    if len(heads) > 64:
        return F.col("block").isin(blocks)
    test = F.lit(False)
    for a, b in zip(heads, tails):
        test = test | F.col("block").between(a, b)
    return test


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    """An index as `write_blocks` left it."""
    about = spark.read.parquet(f"{path}/about").first()
    return BlockIndex(spark, path, about["buckets"], about["blocks"], about["posts"])
