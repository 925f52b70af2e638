"""Mixing sources to target weights: a token budget goes down a tree of domains, languages, sources.

At every node the budget is shared among the children by weight. A child that has too little
passes its shortage to its siblings; only what no sibling can take is missing at the node itself,
and so goes to the node's own siblings. A leaf then takes whole seeded epochs of its documents and
a token-prefix of the next one. All of it is built-in expressions.
"""

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflow.llm.support import settle, unused

ROWS_A_BUCKET = 20_000


def node_name(value: Column) -> Column:
    """A null name is a node of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def leaf_budgets(tree: DataFrame, names: list[str], budget: int, max_epochs: int) -> DataFrame:
    """`(*names, budget)`: the tokens that each leaf may spend.

    A row of `tree` is a leaf: its path `names`, the weight `<name>_w` of every node on it, and the
    tokens `available`. Null or negative weights count as 0, and a node of weight 0 gets nothing.
    A leaf can spend its tokens `max_epochs` times. The tree has a row per node, however many
    documents there are.
    """
    nodes = {}
    below = tree.withColumn("_cap", (F.col("available") * max_epochs).cast("double"))
    for depth in range(len(names), 0, -1):
        own = F.greatest(F.coalesce(F.col(f"{names[depth - 1]}_w"), F.lit(0.0)), F.lit(0.0))
        below = below.withColumn("_w", own).withColumn("_cap", F.when(F.col("_w") > 0, F.col("_cap")).otherwise(0.0))
        nodes[depth] = below.select(*names[:depth], "_w", "_cap")
        upper = [F.first(f"{n}_w").alias(f"{n}_w") for n in names[:depth - 1]]
        below = below.groupBy(*names[:depth - 1]).agg(F.sum("_cap").alias("_cap"), *upper)
    spent = below.select(F.least(F.coalesce(F.col("_cap"), F.lit(0.0)), F.lit(float(budget))).alias("_budget"))
    for depth in range(1, len(names) + 1):
        parents = names[:depth - 1]
        given = nodes[depth].join(spent, parents) if parents else nodes[depth].crossJoin(F.broadcast(spent))  # one row
        spent = _share(given, parents, names[:depth])
    return spent.withColumnRenamed("_budget", "budget")


def _share(children: DataFrame, parents: list[str], names: list[str]) -> DataFrame:
    """Fill siblings by weight, each up to its cap, as water fills vessels.

    Sorted by cap over weight, the level of water is the largest of (budget - caps before) /
    (weights from here on).
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("_cap") / F.col("_w"), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    filled = (
        children.where(F.col("_w") > 0)
        .withColumn("_level", level)
        .withColumn("_water", F.max("_level").over(siblings))
    )
    return filled.select(*names, F.least(F.col("_cap"), F.col("_w") * F.col("_water")).alias("_budget"))


def mix_copies(
    documents: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Column],
    tokens: Column,
    share: float = 1.0,
    max_epochs: int = 1,
    seed: int = 0,
    key: str = "doc_id",
    name: str = "copies",
) -> DataFrame:
    """All rows and columns of `documents` plus `copies`, or another `name`, how often the mixture has the row.

    `levels` names the tree's levels, from the root down, and gives their columns; `weights` see
    those names. The budget is `share` of all tokens. `tokens` null counts as 0; documents of no
    tokens cost nothing. The order within an epoch is a hash of seed, epoch and `key`; rows of
    one leaf with the same key are in or out together. Null names are nodes of their own. An empty
    table stays empty. A column of that name is replaced.

    Only keys, names and token counts are shuffled, never texts. A hot leaf's order is cut into
    hash ranges, whose sums are added up first; only the range that the budget ends in is sorted.
    """
    names = [f"_level_{i}" for i in range(len(levels))]
    named = {n: node_name(c) for n, c in zip(names, levels.values())}
    counted = F.coalesce(tokens.cast("long"), F.lit(0))
    narrow = settle(
        documents.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in named.items()], counted.alias("_tokens")),
        "mix-rows",
    )
    stats = settle(
        narrow.groupBy(*names).agg(F.sum("_tokens").alias("available"), F.count("*").alias("_rows")), "mix-leaves"
    )
    total = stats.agg(F.sum("available")).first()[0] or 0
    shown = {name: F.expr(f"if({n} = 'null', null, substring({n}, 2))") for name, n in zip(levels, names)}
    # A node's weight depends on its own path only, so each of its leaves has it.
    valued = stats.select(*names, "available", *[c.alias(level) for level, c in shown.items()])
    valued = valued.select(*names, "available", *[weights[l].cast("double").alias(f"{n}_w") for l, n in zip(levels, names)])
    budgets = leaf_budgets(valued, names, math.floor(total * share), max_epochs)
    plan = settle(
        stats.join(budgets, names, "left")
        .withColumn("budget", F.coalesce("budget", F.lit(0.0)))
        .withColumn("_epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0))
        .withColumn("_rest", F.col("budget") - F.col("_epochs") * F.col("available"))
        # Hex digits of the order that make up a range.
        .withColumn("_digits", F.ceil(F.log2(F.greatest(F.col("_rows") / ROWS_A_BUCKET, F.lit(1.0))) / 4).cast("int"))
        .select(*names, "_epochs", "_rest", "_digits", "budget"),
        "mix-plan",
    )
    place = lambda column: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_epochs"), column).cast("binary"))
    ordered = narrow.join(plan, names).withColumn("_place", place(F.col("_key")))
    ordered = ordered.withColumn("_range", F.expr("substring(_place, 1, _digits)"))
    sums = ordered.groupBy(*names, "_range").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_limit"))
    upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
        .where((F.col("_before") <= F.col("_limit")) & (F.col("_before") + F.col("_sum") > F.col("_limit")))
        .select(*names, "_range", "_before")
    )
    inside = Window.partitionBy(*names).orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        ordered.join(ends, [*names, "_range"])
        .withColumn("_upto", F.sum("_tokens").over(inside) + F.col("_before"))
        .groupBy(*names)
        # Nothing of the range fits: everything before it does.
        .agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_place"))).alias("_in"), F.first("_range").alias("_range"))
        .select(*names, F.coalesce("_in", "_range").alias("_last"))
    )
    # No range holds the budget's end: the rest covers the leaf. "g" is above every hex digit.
    decided = settle(
        plan.join(last, names, "left").select(*names, "_epochs", F.coalesce("_last", F.lit("g")).alias("_last")), "mix-ends"
    )
    # The table's own columns are apart from those of the plan, whatever their names are.
    row, = unused(documents, "row")
    rows = documents.drop(name)
    paths = [c.alias(n) for n, c in named.items()]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(row), F.col(key).alias("_key"), *paths)
    copies = F.col("_epochs") + F.when(place(F.col("_key")) <= F.col("_last"), 1).otherwise(0)
    return packed.join(decided, names).select(f"{row}.*", copies.cast("long").alias(name))
