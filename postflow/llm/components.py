"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from postflow.llm.support import settle


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `edges` `(a, b)`; the component is its least node.

    Each step links the neighbours of a node to the least of them, the larger ones in the large
    star and the smaller ones in the small star, until all links are stars. Minima combine before the
    shuffle; a node with very many neighbours is split by the adaptive skew join. Self links,
    repeated links and null ends are of no account.

    The driver keeps records of each task, so a step has few shuffles, and no step is spent on
    seeing that nothing changes any more.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    while True:
        links = settle(_small_star(_large_star(links)), "stars")
        if not _unfinished(links):
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    # Every link's larger end is `a` already.
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("end")).select("end.a", "end.b")
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a")
    # A row per link, so repeated ones can wait for the small star.
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    # One shuffle serves the minima and the join. A row of the minimum itself links its `a`, any
    # other row its `b`, so neither gets lost.
    links = links.repartition("a")
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return links.join(least, "a").select(moved.alias("a"), F.col("m").alias("b")).distinct()


def _unfinished(links: DataFrame) -> int:
    """How many nodes have several smaller neighbours, or smaller and larger ones; stars have none. `links` are distinct."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")),
    )
    nodes = links.select(F.explode(ends).alias("end")).groupBy("end.node")
    counted = nodes.agg(F.sum("end.smaller").alias("smaller"), F.max("end.larger").alias("larger"))
    return counted.where("smaller > 1 or (smaller > 0 and larger > 0)").count()
