"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample and every row is sent down all of them. A query walks the
forest through one priority queue, nearest margin first, and takes leaves until they hold as many
rows as a calibration against brute force asks for. Equal queries walk once. A leaf's rows and the
queries that took it are both cut into blocks; every block of rows meets every block of queries,
and is ranked by exact distance.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postflow.llm.support import settle

CELLS = 1 << 18  # distances that are held at once
ASKING_A_SALT = 2_000  # queries of one vector that are answered together


@dataclass(frozen=True)
class Search:
    """Bounds of the fit, and what the search has to reach.

    `sample` rows fit the trees and `judges` queries calibrate the search; every row is indexed.
    A group holds about `block` rows and `asking` queries.
    `recall` is what the judges must reach, above the 0.9 that is promised.
    """

    trees: int = 4
    sample: int = 20_000
    leaf: int = 64
    judges: int = 200
    recall: float = 0.96
    block: int = 4_000
    asking: int = 4_000
    seed: int = 5


@dataclass(frozen=True)
class Tree:
    """Node i sends a vector to `high[i]` if its projection on a unit plane exceeds `limit[i]`, else to `low[i]`; a leaf is -1 - its number."""

    planes: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        if not len(self.limit):
            return np.zeros(len(x), np.int64)
        node = np.zeros(len(x), np.int64)
        inner = np.arange(len(x))
        while len(inner):
            at = node[inner]
            above = np.einsum("ij,ij->i", x[inner], self.planes[at]) > self.limit[at]
            node[inner] = np.where(above, self.high[at], self.low[at])
            inner = inner[node[inner] >= 0]
        return -1 - node


def grow_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the line between two random rows, until at most `leaf` rows are left."""
    planes, limit, low, high = [], [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                a, b = rng.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                plane = plane / (np.linalg.norm(plane) or 1.0)
                along = x[rows] @ plane
                cut = np.median(along)
                above = along > cut
                if above.any():
                    node = len(limit)
                    for values, value in ((planes, plane), (limit, cut), (low, 0), (high, 0)):
                        values.append(value)
                    low[node], high[node] = split(rows[~above]), split(rows[above])
                    return node
        leaves += 1
        return -leaves

    split(np.arange(len(x)))
    width = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(planes).reshape(-1, width), np.array(limit), np.array(low, np.int64), np.array(high, np.int64), leaves)


def probe(forest: list[Tree], query: np.ndarray, sizes: list[np.ndarray], budget: float) -> list[tuple[int, int]]:
    """Leaves `(tree, leaf)` in the order of the shared queue, until they hold `budget` rows."""
    queue = [(0.0, t, 0 if len(tree.limit) else -1) for t, tree in enumerate(forest)]
    projected = [tree.planes @ query - tree.limit if len(tree.limit) else np.zeros(0) for tree in forest]
    taken, found = 0, []
    heapq.heapify(queue)
    while queue and taken < budget:
        margin, t, node = heapq.heappop(queue)
        while node >= 0:
            tree, side = forest[t], projected[t][node]
            near, far = (tree.high[node], tree.low[node]) if side > 0 else (tree.low[node], tree.high[node])
            heapq.heappush(queue, (max(margin, abs(side)), t, int(far)))
            node = int(near)
        found.append((t, -1 - node))
        taken += sizes[t][-1 - node]
    return found


def usable(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """`(id, v)` of the rows that take part: of the most frequent dimension, finite, not zero."""
    v = F.col(column).cast("array<double>")
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(_fine(F.col("v")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def _fine(v: Column) -> Column:
    """Every component is a finite number and one of them is not zero."""
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return finite & F.exists(v, lambda x: x != 0)


def without_spare_copies(rows: DataFrame, k: int) -> DataFrame:
    """`rows` without the copies of a vector that can be among no query's `k` nearest.

    Copies are equally far from everything and ties go to the smaller id, so of one vector the
    `k + 1` smallest ids are enough, the query's own being among them at most once. Repeated ids
    count once. Only digests and ids are counted.
    """
    marked = rows.withColumn("_digest", F.md5(F.to_json("v").cast("binary"))).dropDuplicates(["id", "_digest"])
    narrow = marked.select("_digest", "id")
    crowded = narrow.groupBy("_digest").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("_digest")
    order = F.row_number().over(Window.partitionBy("_digest").orderBy("id"))
    last = (
        narrow.join(crowded, "_digest", "left_semi").withColumn("_r", order).where(F.col("_r") <= k + 1)
        .groupBy("_digest").agg(F.max("id").alias("_last"))
    )
    kept = marked.join(last, "_digest", "left").where(F.col("_last").isNull() | (F.col("id") <= F.col("_last")))
    return kept.drop("_digest", "_last")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, how: Search = Search(), key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Each query's `k` nearest other rows of `vectors`: `(query_id, rank, vec_id, score)`.

    `queries` has the same columns; a row is no candidate for the query of its own id. `score` is
    the Euclidean distance in double precision; ties go to the smaller id. Rows with a null id, a
    null, zero or unusual-length vector or a component that is null or not finite take no part;
    repeated rows count once, an id asked with two vectors asks with the smaller; fewer than `k` candidates are all returned. Further columns are
    ignored, empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = settle(without_spare_copies(usable(vectors, column, key), k), "vectors")
    asked = usable(queries, column, key).groupBy("id").agg(F.min("v").alias("v"))
    asked = settle(asked.withColumn("_digest", F.md5(F.to_json("v").cast("binary"))), "vector-queries")
    shuffled = F.xxhash64(F.lit(how.seed), "id")
    picked = rows.orderBy(shuffled, "id").limit(how.sample).collect()
    sample = np.array([r["v"] for r in picked])
    rng = np.random.default_rng(how.seed)
    forest = [grow_tree(sample, how.leaf, rng) if len(sample) else Tree(np.zeros((0, 0)), *[np.zeros(0, np.int64)] * 3, 1) for _ in range(how.trees)]
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            leaf = [tree.route(x) for tree in shared.value] if len(x) else [np.zeros(0, np.int64)] * how.trees
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(list(np.array(leaf).T), pa.list_(pa.int64()))], names=["id", "v", "leaf"]
            )

    routed = settle(rows.mapInArrow(to_leaves, "id long, v array<double>, leaf array<long>"), "vector-leaves")
    entries = routed.select("id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    sizes = [np.zeros(max(tree.leaves, 1), np.int64) for tree in forest]
    for r in entries.groupBy("tree", "leaf").count().collect():  # a row per leaf, bounded by the sample
        sizes[r["tree"]][r["leaf"]] = r["count"]
    judges = [(r["id"], np.array(r["v"])) for r in asked.orderBy(shuffled, "id").limit(how.judges).collect()]
    budget = _calibrate(routed, judges, forest, sizes, k, how)

    known = spark.sparkContext.broadcast(sizes)

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            took = [[f"{t} {l}" for t, l in probe(shared.value, q, known.value, budget)] for q in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(took, pa.list_(pa.string()))], names=["id", "v", "took"]
            )

    # Of equal queries the one of the least id walks and is answered, with one result more for its own id.
    walking = asked.groupBy("_digest").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("_n"))
    walked = settle(walking.select("id", "v").mapInArrow(to_probes, "id long, v array<double>, took array<string>"), "vector-probes")
    place = F.split("took", " ")
    probes = walked.select("id", "v", F.explode("took").alias("took")).select(
        "id", "v", place[0].cast("int").alias("tree"), place[1].cast("long").alias("leaf")
    )
    # A row per leaf.
    asking = {(r["tree"], r["leaf"]): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}
    groups = _groups(sizes, asking, how)
    # Made for each side, as a table that both sides had joined would make the columns of a group ambiguous.
    parts = lambda: F.broadcast(spark.createDataFrame(groups, "tree int, leaf long, group int, _blocks long, _askings long"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = entries.join(parts(), ["tree", "leaf"]).withColumn("block", part("_blocks")).withColumn("asking", every("_askings"))
    probes = probes.join(parts(), ["tree", "leaf"]).withColumn("asking", part("_askings")).withColumn("block", every("_blocks"))
    columns, group = ["tree", "leaf", "id", "v", "group", "block", "asking"], ["group", "block", "asking"]

    def meet(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        where = candidates.groupby(["tree", "leaf"]).indices
        for place, at in asking.groupby(["tree", "leaf"]).indices.items():
            if place in where:
                c, q = candidates.iloc[where[place]], asking.iloc[at]
                found.append(_closest(q["id"].to_numpy(), np.stack(q["v"]), c["id"].to_numpy(), np.stack(c["v"]), k + 1, own=True))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        best = pd.concat(found).sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
        return best.groupby("query_id").head(k + 1)

    met = held.select(*columns).groupBy(*group).cogroup(probes.select(*columns).groupBy(*group))
    found = met.applyInPandas(meet, "query_id long, vec_id long, score double")
    pairs = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = pairs.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    answers = best.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("_near"))
    # Back to all queries of a vector: an answer a salt, as many as its queries need, so that a frequent vector does not land in one task.
    salts = F.ceil(F.col("_n") / ASKING_A_SALT)
    answers = answers.join(walking.select("id", "_digest", "_n"), "id").select("_digest", "_near", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    asked = asked.join(walking.select("_digest", "_n"), "_digest")
    salted = asked.select(F.col("id").alias("query_id"), "_digest", F.pmod(F.xxhash64("id"), salts).alias("_salt"))
    others = F.slice(F.filter("_near", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    listed = salted.join(answers, ["_digest", "_salt"]).select("query_id", F.posexplode(others).alias("_at", "_r"))
    return listed.select("query_id", (F.col("_at") + 1).alias("rank"), "_r.vec_id", "_r.score")


def _groups(sizes: list[np.ndarray], asking: dict[tuple[int, int], int], how: Search) -> list[tuple[int, int, int, int, int]]:
    """`(tree, leaf, group, blocks, askings)` of every leaf that was taken: small leaves share a group, a larger one has its own."""
    out, group, rows, queries = [], 0, 0, 0
    for (t, l), n in sorted(asking.items()):
        size = int(sizes[t][l])
        if rows + size > how.block or queries + n > how.asking:
            group, rows, queries = group + 1, 0, 0
        rows, queries = rows + size, queries + n
        out.append((t, l, group, max(-(-size // how.block), 1), max(-(-n // how.asking), 1)))
    return out


def _closest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, own: bool = False) -> pd.DataFrame:
    """Each query's `k` nearest of `x` by exact distance, its own id only if `own`; `CELLS` distances at a time."""
    step = max(1, CELLS // max(len(ids), 1))
    found = [_closest_slice(query_ids[a:a + step], q[a:a + step], ids, x, k, own) for a in range(0, len(q), step)]
    return pd.concat(found) if found else _closest_slice(query_ids, q, ids, x, k, own)


def _closest_slice(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, own: bool) -> pd.DataFrame:
    """A product of matrices only picks whom to measure; whom it cannot place, as squares overflow, is measured."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = (q ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1)[None, :] - 2.0 * (q @ x.T)
        slack = 1e-9 * ((q ** 2).sum(axis=1) + (x ** 2).sum(axis=1).max())
        unplaced = ~np.isfinite(rough)
        rough[unplaced] = np.inf
        mine = query_ids[:, None] == ids[None, :] if not own else np.zeros((1, 1), bool)
        rough[np.broadcast_to(mine, rough.shape)] = np.inf
        reach = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
        row, col = np.nonzero(((rough <= (reach + slack)[:, None]) & (rough < np.inf) | unplaced) & ~mine)
        score = np.empty(len(row))
        step = max(1, 16 * CELLS // max(x.shape[1], 1))
        for a in range(0, len(row), step):
            score[a:a + step] = distances(q[row[a:a + step]] - x[col[a:a + step]])
    found = pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[col], "score": score})
    return found.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)


def distances(apart: np.ndarray) -> np.ndarray:
    """The lengths of differences; where squares would overflow or vanish, by way of the largest component."""
    squares = (apart ** 2).sum(axis=1)
    out = np.sqrt(squares)
    odd = ~((squares > 1e-280) & (squares < np.inf))
    if odd.any():
        most = np.abs(apart[odd]).max(axis=1, initial=0.0)
        unit = apart[odd] / np.where(most > 0, most, 1.0)[:, None]
        out[odd] = most * np.sqrt((unit ** 2).sum(axis=1))
    return out


def _calibrate(
    routed: DataFrame, judges: list[tuple[int, np.ndarray]], forest: list[Tree], sizes: list[np.ndarray], k: int, how: Search
) -> float:
    """Rows of leaves that a query has to take so that the judges reach `how.recall`, found by brute force over all rows."""
    if not judges:
        return 0.0
    ids, q = np.array([i for i, _ in judges]), np.stack([v for _, v in judges])

    def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            own = batch.column("id").to_numpy()
            found = _closest(ids, q, own, x, k)
            at = pa.array(pd.Index(own).get_indexer(found["vec_id"]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["query_id"].to_numpy()), batch.column("id").take(at), pa.array(found["score"].to_numpy()), batch.column("leaf").take(at)],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    near = routed.mapInArrow(against_all, "query_id long, vec_id long, score double, leaf array<long>")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    truth = near.withColumn("rank", rank).where(F.col("rank") <= k).collect()  # judges x k rows
    order = {}
    for i, v in judges:
        places = probe(forest, v, sizes, np.inf)
        upto = np.cumsum([0] + [sizes[t][l] for t, l in places])
        order[i] = {place: upto[n] for n, place in enumerate(places)}
    # A neighbour is found once fewer rows than this are taken before the first of its leaves.
    needed = np.sort([min(order[r["query_id"]][(t, l)] for t, l in enumerate(r["leaf"])) for r in truth])
    return float(needed[min(len(needed) - 1, int(np.ceil(how.recall * len(needed))))] + 1) if len(needed) else 0.0
