"""Centroid clustering in whole numbers, the nearest centroid found by the threshold algorithm.

Each dimension has the centroids sorted by their value there. A vector walks each of these lists
outward from its own value. The next distances on the lists, squared and added up, bound the
distance of every centroid not met yet, so the walk ends once they exceed the best exact one.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postflow.llm.support import settle

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
MOST = 1 << 27  # larger components count as this, so that a squared distance is a long
BLOCK = 2_048  # vectors that walk at once
FAR = np.int64(1 << 62)
LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`(vec_id, v)`: vectors of exactly `dimensions` components, none null or non-finite, as floor(1024 * x).

    Components beyond +-2**27 after that count as +-2**27. Other vectors are left out; null and
    repeated keys stay.
    """
    vector = F.col(column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))).cast("int"))
    return embeddings.where(F.size(vector) == dimensions).where(finite).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 3) -> np.ndarray:
    """The `k` vectors with the least sha256 of `seed:vec_id`, in that order; fewer if there are fewer.

    Equal ids come in the order of their components, null ids last.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(place.alias("place"), "v").orderBy(F.asc_nulls_last("place"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


class Lists:
    """Per dimension the centroids' values in order, and whose they are; a far value stands at either end."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dimensions = centroids.shape
        self.owner = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.take_along_axis(centroids, self.owner.T, axis=0).T

    def walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid, the smaller number of equal ones, and the squared distance."""
        n, dims, k = len(vectors), self.dimensions, self.k
        high = np.empty((n, dims), np.int64)  # the next place upward; `low` the next one downward
        for d in range(dims):
            high[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        low = high - 1
        seen = np.zeros((n, k), bool)
        best, nearest = np.full(n, FAR), np.full(n, k, np.int64)
        gaps = np.stack([self._gap(vectors[:, d], d, low[:, d], high[:, d])[0] for d in range(dims)], axis=1)
        bound, walking = gaps.sum(axis=1), np.arange(n)
        step = 0
        while len(walking):
            d = step % dims
            step += 1
            x = vectors[walking, d]
            gap, up = self._gap(x, d, low[walking, d], high[walking, d])
            place = np.where(up, high[walking, d], low[walking, d])
            met = self.owner[d][np.clip(place, 0, k - 1)]
            fresh = ~seen[walking, met] & (gap < FAR)
            rows, own = walking[fresh], met[fresh]
            seen[rows, own] = True
            apart = vectors[rows] - self.centroids[own]
            exact = np.einsum("ij,ij->i", apart, apart)
            closer = (exact < best[rows]) | ((exact == best[rows]) & (own < nearest[rows]))
            best[rows[closer]], nearest[rows[closer]] = exact[closer], own[closer]
            high[walking, d] += up
            low[walking, d] -= ~up
            # The frontier of this list moves on; a list that has ended has shown every centroid.
            after, _ = self._gap(x, d, low[walking, d], high[walking, d])
            ended = after == FAR
            bound[walking] += np.where(ended, 0, after - gaps[walking, d])
            gaps[walking, d] = np.where(ended, gaps[walking, d], after)
            walking = walking[(bound[walking] <= best[walking]) & ~ended & ~seen[walking].all(axis=1)]
        return nearest, best

    def _gap(self, x: np.ndarray, d: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The squared distance to the nearer of the next values, `FAR` at both ends, and whether it lies upward."""
        values = self.values[d]
        under = np.where(low >= 0, (x - values[np.maximum(low, 0)]) ** 2, FAR)
        over = np.where(high < self.k, (values[np.minimum(high, self.k - 1)] - x) ** 2, FAR)
        return np.minimum(under, over), over < under


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = flat.reshape(batch.num_rows, -1)
    for at in range(0, batch.num_rows, BLOCK):
        yield slice(at, at + BLOCK), vectors[at:at + BLOCK]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that is nearest to some vector becomes the floor of their mean, component by component.

    Each task adds up its own vectors; the driver gets one number per centroid and component.
    """
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

        def rows():
            own = np.flatnonzero(count)
            places = np.tile(np.arange(dims), len(own))
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (np.repeat(own, dims), places, np.repeat(count[own], dims), total[own].ravel())],
                names=["cluster", "place", "n", "total"],
            )

        for batch in batches:
            for _, block in _batches(batch):
                nearest, _ = lists.walk(block)
                np.add.at(total, nearest, block)
                count += np.bincount(nearest, minlength=k)
            if count.sum() > 1 << 34:  # long before a sum could pass a long
                yield rows()
                count[:], total[:] = 0, 0
        yield rows()

    sums = vectors.select("v").mapInArrow(add, "cluster long, place long, n long, total long").groupBy("cluster", "place")
    out = centroids.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def fit_centroids(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids after `rounds` rounds over written `vectors`; the driver holds `k` vectors."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`(vec_id, cluster, distance)` of every vector; the distance is squared."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            for rows, block in _batches(batch):
                nearest, distance = lists.walk(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[rows], pa.array(nearest.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return vectors.mapInArrow(near, "vec_id long, cluster int, distance long")


def cluster(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """`(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)` per vector that takes part.

    Vectors that do are those of `whole_vectors`. With fewer than `k` of them there are as many
    centroids; equal vectors fall to the smaller number. Sums beyond a long are given as the
    largest long. An empty table gives no row; null and repeated keys stay; further columns are
    ignored.
    """
    vectors = settle(whole_vectors(embeddings, dimensions, key, column), "vectors")
    centroids = fit_centroids(vectors, k, rounds, seed)
    spark = embeddings.sparkSession
    placed = settle(assign(vectors, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(LONG, sum(sums.values()))
    about = [
        (c, min(LONG, s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()
    ]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
