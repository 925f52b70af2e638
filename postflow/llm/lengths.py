"""Exact token counts: a histogram of encoded lengths, and what its suffix sums answer."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postflow.llm.support import settle
from postflow.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, encode

BLOCK = 1024  # lengths summed together first, so that no task gets all of them


def length_histogram(documents: DataFrame, vocabulary: str = BYTE_BPE, ranks: str | None = BYTE_BPE_RANKS) -> DataFrame:
    """`(n_tokens, documents)`: how many rows of `documents` have each encoded length.

    Only `text` is read. Null and empty texts have length 0; copies and ties count each; an empty
    table has no lengths. Counts combine before the shuffle, so a frequent length is no hot key.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: len(encode(t, vocabulary, ranks)) if t else 0).astype("int64")

    counted = documents.select(tokens(F.col("text").cast("string")).alias("n_tokens"))
    return counted.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def length_totals(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each encoded length L, taken as a context limit, sums over all documents.

    `at_least` and `tokens_at_least`: documents of L tokens or more, and their tokens;
    `truncated_tokens`: all tokens left when texts are cut to L; `quantile`: the share of
    documents of at most L tokens. Suffix sums go over blocks of lengths, then inside each block.
    """
    rows = settle(
        histogram.select(
            "n_tokens", "documents",
            (F.col("n_tokens") * F.col("documents")).alias("_tokens"),
            F.floor(F.col("n_tokens") / block).alias("_block"),
        ),
        "lengths",
    )
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    # A row per block: the longest text's tokens over 1,024, however many documents there are.
    blocks = rows.groupBy("_block").agg(F.sum("documents").alias("_d"), F.sum("_tokens").alias("_t")).select(
        "_block",
        F.coalesce(F.sum("_d").over(after), none).alias("_d_after"),
        F.coalesce(F.sum("_t").over(after), none).alias("_t_after"),
    )
    totals = rows.agg(F.sum("documents").alias("_all"), F.sum("_tokens").alias("_all_tokens"))
    within = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    suffix = (
        rows.join(blocks, "_block")
        .withColumn("at_least", F.sum("documents").over(within) + F.col("_d_after"))
        .withColumn("tokens_at_least", F.sum("_tokens").over(within) + F.col("_t_after"))
        .join(F.broadcast(totals))  # one row
    )
    shorter = F.col("_all_tokens") - F.col("tokens_at_least")
    return suffix.select(
        "n_tokens", "documents", "at_least", "tokens_at_least",
        (shorter + F.col("n_tokens") * F.col("at_least")).alias("truncated_tokens"),
        ((F.col("_all") - F.col("at_least") + F.col("documents")) / F.col("_all")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents, their tokens, and the tokens left when texts are cut to `limit`."""
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("documents")
    return histogram.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("documents")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_tokens"),
    )
