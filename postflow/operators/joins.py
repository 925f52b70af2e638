"""Replay join and lookup join, and how both split keys that many rows have."""

import math

from pyspark.sql import DataFrame, functions as F

from postflow.staging import stage, unused

HOT_SHARE = 0.001  # a key with at least this share of the rows is hot, so at most 1,000 are
HOT_ROWS = 100_000  # and this many rows
HOT_BYTES = 64 << 20  # up to here the dimension rows of hot keys are broadcast


def replay_join(ticks: DataFrame, indexed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each tick picks the post of that index; ticks past the last post pick none.

    `ticks` has the column `value`, batch or stream; `indexed` comes from `dense_index`. Indexes
    are unique; a tick that repeats very often is split as a hot key, except in a stream, where
    it cannot be counted ahead.
    """
    wanted = ticks.select(F.col("value").cast("long").alias("index"))
    if wanted.isStreaming:
        return wanted.join(indexed, "index")
    return _counted_join(wanted, indexed, "index", "inner", None, hot_rows, HOT_BYTES)


def enrich_join(
    facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner", hot: list | None = None,
    hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Look `key` up in a dimension that has each key once.

    A dimension with a repeated key is an error, since it would multiply facts. `hot` names the
    keys to split; by default they are counted, and facts that have any are written once.
    """
    require_unique(dimension, key)
    return _counted_join(facts, dimension, key, how, hot, hot_rows, hot_bytes)


def _counted_join(facts, dimension, key, how, hot, hot_rows, hot_bytes) -> DataFrame:
    if hot is None:
        hot = hot_keys(facts, key, at_least=hot_rows)
        # The facts are read twice below. Written, they are computed no more than twice in all.
        facts = stage(facts, "facts") if hot else facts
    return split_join(facts, dimension, key, hot, how, hot_bytes)


def require_unique(df: DataFrame, key: str) -> None:
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    found = repeated.select(key).take(1)
    if found:
        raise ValueError(f"{key} {found[0][0]!r} occurs more than once in the dimension")


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose `key` no other row has, and the others, None if there are none. Null is a key.

    Only keys are shuffled, and those that repeat are written once.
    """
    other, = unused(df, "repeated")
    counted = df.groupBy(F.col(key).alias(other)).agg(F.count("*").alias("rows"))
    found = stage(counted.where("rows > 1").select(other), "repeated-keys")
    if found.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col(other))
    return df.join(found, same, "left_anti"), df.join(found, same, "left_semi")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, at_least: int = 100_000) -> list:
    """Keys with at least `share` of the non-null rows, and `at_least` rows.

    One job counts the keys and, as the rollup's last row, all of them; counts are combined
    before the shuffle. No more than `1 / share` keys can qualify, so the list on the driver is
    bounded whatever the data.
    """
    counts = (
        df.where(F.col(key).isNotNull())
        .rollup(key)
        .agg(F.count("*").alias("rows"), F.grouping_id().alias("is_total"))
        .where((F.col("rows") >= at_least) | (F.col("is_total") == 1))
        .orderBy(F.desc("rows"))
        .limit(math.ceil(1 / share) + 1)
        .collect()
    )
    total = sum(r.rows for r in counts if r.is_total)
    return [r[key] for r in counts if not r.is_total and r.rows >= share * total]


def split_join(
    facts: DataFrame, dimension: DataFrame, key: str, hot: list, how: str = "inner", hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Inner or left join on `key`, where the facts of hot keys stay out of the shuffle on it.

    The dimension has a key once, so the rows of the hot keys are as few as those. They are
    broadcast after their size is checked, to facts that are first dealt evenly over the tasks,
    as they may come from a shuffle on the same key. Larger ones are joined as the others are,
    and left to the adaptive skew join. In a left join the facts without a key are dealt evenly too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', got {how!r}")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    few = dimension.where(is_hot)
    size = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0 if hot else 0
    if size > hot_bytes:
        is_hot = F.lit(False)
    apart = is_hot | F.col(key).isNull() if how == "left" else is_hot
    if (not hot or size > hot_bytes) and how == "inner":
        return facts.join(dimension, key)
    cold = facts.where(~apart).join(dimension, key, how)
    dealt = facts.where(apart).repartition(facts.sparkSession.sparkContext.defaultParallelism)
    return cold.unionByName(dealt.join(F.broadcast(few if size <= hot_bytes else few.limit(0)), key, how).select(cold.columns))
