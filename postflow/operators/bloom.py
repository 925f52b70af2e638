"""A Bloom filter as a table: which ids may be in a stored set, without reading the set."""

import functools

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS, WORD_BITS = 256, 64
BITS_AN_ID = 32
PROBES = 16  # bits of a block that an id sets: about one id in 500,000 is taken for one it is not
WORDS = [f"w{i}" for i in range(BLOCK_BITS // WORD_BITS)]


def blocks_for(ids: int) -> int:
    """Blocks of a filter over so many ids."""
    return max(1, -(-ids * BITS_AN_ID // BLOCK_BITS))


def build_filter(ids: DataFrame, blocks: int) -> DataFrame:
    """`(block, w0, ...)`: the bits of all non-null `id`s. All bits of an id lie in one block, combined before the shuffle."""
    masked = _masked(ids.where(F.col("id").isNotNull()), blocks)
    return masked.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def may_hold(ids: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The `id`s that may be among those the filter was built of; all that are, and few others."""
    masked = _masked(ids, blocks)
    held = bloom.select("block", *[F.col(w).alias(f"held_{w}") for w in WORDS])
    all_set = functools.reduce(Column.__and__, [F.col(f"held_{w}").bitwiseAND(F.col(w)) == F.col(w) for w in WORDS])
    return masked.join(held, "block").where(all_set).select("id")


def _masked(ids: DataFrame, blocks: int) -> DataFrame:
    """Each id with its block and, per word of it, the bits that it sets."""
    hashed = ids.select(
        "id", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(2), "id").alias("hash0"),
        F.xxhash64(F.lit(3), "id").alias("hash1"),
    )
    bit = [F.shiftright(f"hash{n // 8}", 8 * (n % 8)).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in range(PROBES)]

    def word(number: int) -> Column:
        own = [
            F.when(F.shiftright(b, 6) == number, F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")))
            .otherwise(F.lit(0).cast("bigint"))
            for b in bit
        ]
        return functools.reduce(Column.bitwiseOR, own)

    return hashed.select("id", "block", *[word(n).alias(w) for n, w in enumerate(WORDS)])
