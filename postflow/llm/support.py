"""What several operators share: written tables, the bytes of a batch, word and shingle hashes."""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postflow.staging import discard, stage, unused  # noqa: F401

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 1 << 18  # texts are worked on in slices of about this size
RANK_ROWS, RANK_PARTS = 1_000, 50_000

# The white space that separates words, and ASCII upper case.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_SPACE = np.isin(np.arange(256), list(SPACES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder, read it back, and let go of its shuffle files at once.

    The written table outlives lost executors, so the shuffles behind it are not needed again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return stage(df, label, compression)
    finally:
        conf.set(CLEANUP, before)


def release(df: DataFrame) -> None:
    """Delete a table of `settle` that everything made of it no longer needs, as it is written itself."""
    files = df.inputFiles()
    if files:
        discard(df.sparkSession, files[0].rpartition("/")[0])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one entry more); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    starts = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    starts = starts[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0]:starts[-1]]
    return data, starts - starts[0]


def slices(starts: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of whole texts of about `size` bytes; a longer text is a run of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a fixed bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: first byte, byte after the last, text number, 64-bit hash.

    `starts` are the texts' places in `data`, from 0. A word never spans two texts. The hash is
    a polynomial over the bytes modulo 2**64, taken from running sums, and mixed.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = starts[1:][starts[1:] > 0] - 1
    ends[tails] = inside[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(starts, first, side="right") - 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _powers_of(_BASE, n), out=sums[1:])
        hashes = mix((sums[last] - sums[first]) * _powers_of(_INVERSE, n)[first] + (last - first).astype(np.uint64))
    return first, last, owner, hashes


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the distinct hashes, sorted, of its runs of `size` ASCII-lower-cased words.

    A text with fewer words has its whole sequence as its one run, and none without words.
    """
    for shingles, starts in shingle_slices(texts, size):
        yield from (shingles[a:b] for a, b in zip(starts, starts[1:]))


def shingle_slices(texts: pa.Array, size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of `shingle_sets` in a row, slice by slice of the texts, and where each begins (one entry more)."""
    data, starts = text_bytes(texts)
    for a, b in slices(starts):
        part = LOWER[data[starts[a]:starts[b]]]
        _, _, owner, hashes = words_of(part, starts[a:b + 1] - starts[a])
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        runs = _runs(hashes, size)
        sets = []
        for first, last in zip(cuts, cuts[1:]):
            if last - first >= size:
                sets.append(runs[first:last - size + 1])
                sets[-1].sort()
            else:
                sets.append(_runs(hashes[first:last], last - first))
        yield _distinct(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))


def _distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`values` without those that repeat the one before in their sorted run, and where the runs then begin."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[starts[:-1][starts[:-1] < len(values)]] = True
    return values[first], np.concatenate([[0], np.cumsum(first)])[starts]


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words."""
    if not size or len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + hashes[k:len(hashes) - size + 1 + k]
    return mix(total + np.uint64(size))


def ranked(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """A written `df` with `rank` counting 0, 1, ... without gaps inside each `group`.

    For few, possibly huge groups. Each is cut by a hash of `order` into parts of about
    `rows / RANK_PARTS`, rows are numbered inside a part, and the sizes of the parts before are
    added. The driver sees a row per part, at most RANK_PARTS and one per group. Rows equal in
    all of `order` stay in one part.
    """
    spark = df.sparkSession
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).collect()
    kind = dict(df.dtypes)[group]
    size = max(RANK_ROWS, sum(r["_n"] for r in counts) // RANK_PARTS)
    parts = spark.createDataFrame([(r[group], -(-r["_n"] // size)) for r in counts], f"_group {kind}, _parts long")
    cut = df.join(F.broadcast(parts), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    cut = cut.withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    sizes = cut.groupBy(group, "_part").agg(F.count("*").alias("_n")).collect()
    sizes.sort(key=lambda r: (r[group] is None, r[group], r["_part"]))
    offsets, before, last = [], 0, object()
    for r in sizes:
        before = before if r[group] == last else 0
        offsets.append((r[group], r["_part"], before))
        before, last = before + r["_n"], r[group]
    table = spark.createDataFrame(offsets, f"_group {kind}, _piece long, _before long")
    place = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = cut.withColumn("_row", F.row_number().over(place))
    met = numbered.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_piece")))
    return met.withColumn(rank, F.col("_before") + F.col("_row") - 1).drop("_group", "_part", "_piece", "_before", "_row")


def on_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
