"""Sharding indivisible groups by best-fit-decreasing bin packing.

Groups are packed in two steps. Many tasks pack the small groups into bricks, each a small share of
a shard; then the few bricks and the large groups are packed into the shards.
"""

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postflow.llm.support import ranked, settle

BRICKS_A_SHARD = 128
MOST_BRICKS = 200_000
GROUPS_A_TASK = 100_000


class CapacityTree:
    """A balanced search tree (treap) of `(remaining capacity, bin)`."""

    def __init__(self) -> None:
        self._root = None

    def insert(self, key: tuple[int, int]) -> None:
        low, high = _split(self._root, key)
        # A fixed hash of the bin keeps the tree balanced and the result repeatable.
        node = [key, (key[1] * 0x9E3779B97F4A7C15 + key[0]) * 0xBF58476D1CE4E5B9 >> 7 & 0xFFFFFFFF, None, None]
        self._root = _merge(_merge(low, node), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds `size`."""
        low, high = _split(self._root, (size, -1))
        if high is None:
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        _, rest = _split(high, (least[0][0], least[0][1] + 1))
        self._root = _merge(low, rest)
        return least[0]


def _split(node, key):
    """Nodes below `key`, and the others."""
    if node is None:
        return None, None
    if node[0] < key:
        a, b = _split(node[3], key)
        return [node[0], node[1], node[2], a], b
    a, b = _split(node[2], key)
    return a, [node[0], node[1], b, node[3]]


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    if a[1] > b[1]:
        return [a[0], a[1], a[2], _merge(a[3], b)]
    return [b[0], b[1], _merge(a, b[2]), b[3]]


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each size: largest first, each into the tightest bin that holds it, else a new one.

    A size above the capacity has a bin of its own. Ties go by position.
    """
    sizes = list(sizes)
    bins, tree, opened = [0] * len(sizes), CapacityTree(), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        bins[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return bins


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, for a fixed number of shards: the least capacity that needs no more.

    A size above the mean of what is left has a shard to itself, else it would raise the capacity
    of all others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, total, alone = shards, sum(sizes), 0
    out = [0] * len(sizes)
    while left > 1 and alone < len(order) and sizes[order[alone]] * left > total:
        out[order[alone]] = shards - left
        total -= sizes[order[alone]]
        left, alone = left - 1, alone + 1
    rest = order[alone:]
    if not rest:
        return out
    low, high = max(-(-total // left), sizes[rest[0]]), max(2 * -(-total // left), 2 * sizes[rest[0]], 1)
    while low < high:
        middle = (low + high) // 2
        if max(best_fit_decreasing([sizes[i] for i in rest], middle)) < left:
            high = middle
        else:
            low = middle + 1
    for i, b in zip(rest, best_fit_decreasing([sizes[i] for i in rest], high)):
        out[i] = shards - left + b
    return out


def pack_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """`groups` `(group, bytes)` with `shard`, each group whole: `shards` of near equal bytes, or as few as `capacity` allows.

    Small groups go by hash to tasks, which pack them into bricks; a row per brick and per group
    larger than a brick reaches the driver, or per shard where those are more. A null group is a group; an empty table stays empty.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    share = math.ceil((total / shards if shards else capacity) / BRICKS_A_SHARD)
    # With very many shards bricks are larger shares, up to whole ones, so that their number stays bounded.
    brick = max(1, share if shards else min(capacity, max(share, total // MOST_BRICKS)))
    tasks = max(1, math.ceil(n / GROUPS_A_TASK))
    kind = dict(groups.dtypes)["group"]
    small = groups.where(F.col("bytes") <= brick).withColumn("_task", F.pmod(F.xxhash64("group"), F.lit(tasks)))

    def into_bricks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group")
        rows["_brick"] = np.array(best_fit_decreasing(rows["bytes"].tolist(), brick), np.int64)
        return rows[["group", "bytes", "_task", "_brick"]]

    laid = small.groupBy("_task").applyInPandas(into_bricks, f"group {kind}, bytes long, _task long, _brick long")
    # Large groups are bricks by themselves, told apart by task -1 and a hash of the group.
    large = groups.where(F.col("bytes") > brick).select(
        "group", "bytes", F.lit(-1).cast("long").alias("_task"), F.xxhash64("group").alias("_brick")
    )
    placed = settle(laid.unionByName(large), "bricks")
    bricks = placed.groupBy("_task", "_brick").agg(F.sum("bytes").alias("bytes")).collect()
    bricks.sort(key=lambda r: (r["_task"], r["_brick"]))
    sizes = [r["bytes"] for r in bricks]
    found = (near_equal(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)) if sizes else []
    table = spark.createDataFrame(
        [(r["_task"], r["_brick"], s) for r, s in zip(bricks, found)], "_task long, _brick long, shard int"
    )
    return placed.join(F.broadcast(table), ["_task", "_brick"]).select("group", "bytes", "shard")


def shard_documents(documents: DataFrame, shards: int = 24, overhead: int = 8, key: str = "doc_id") -> DataFrame:
    """Every row of `documents` in one of `shards` shards of near equal bytes, equal texts together.

    Returned: `key`, `size` (UTF-8 bytes of the text and `overhead`), `text_crc32`, `shard`, and
    `slot`, gapless from 0 in each shard by a hash order of keys. Null texts are one group, apart
    from empty ones, of no bytes. Texts are not shuffled, only their digests.
    """
    text = F.col("text").cast("string")
    rows = settle(
        documents.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group"),
        ),
        "shard-rows",
    )
    groups = settle(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    packed = pack_groups(groups, shards=shards).select("group", "shard")
    # A group with a third of the rows is split by the adaptive skew join; its one packed row is repeated.
    placed = settle(rows.join(packed.hint("merge"), "group").drop("group"), "shard-placed")
    return ranked(placed, "shard", ["_key"], "slot").withColumnRenamed("_key", key)
