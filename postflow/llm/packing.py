"""Best-fit packing of token pieces into sequences under several capacities at once.

Pieces of one length are alike: they need the same tokens, document slots and attention cost. So
the packing is found on the histogram of lengths, whatever the number of pieces, and every piece
looks its place up by its length and its rank among the pieces of that length.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postflow.llm.support import ranked, settle
from postflow.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, id_array


WEIGHTS = (1.0, 0.5, 0.5)  # of what is left of tokens, document slots and attention, each as a share of its capacity


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold; attention costs a piece the square of its length."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)


def cut_documents(
    documents: DataFrame, size: int = 1024, end: int | None = 2, vocabulary: str = BYTE_BPE,
    ranks: str | None = BYTE_BPE_RANKS, key: str = "doc_id",
) -> DataFrame:
    """`(key, piece, start, length, ids_crc32)` for the token pieces of every row of `documents`.

    A text's ids, then `end`. Up to `size` ids are one piece; more are cut into pieces of `size`,
    of which the first may be shorter. Null text is empty; without `end` an empty text has no
    piece. Row by row: repeated rows have repeated pieces.
    """
    text = F.col("text").cast("string")
    narrow = documents.select(F.col(key).alias("_key"), text.alias("text"))
    kind = narrow.schema["_key"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = id_array(text.as_py(), end, vocabulary, ranks)
                edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) else [0]
                for k in range(len(edges) - 1):
                    rows.append(row)
                    piece.append(k)
                    start.append(edges[k])
                    length.append(edges[k + 1] - edges[k])
                    crc.append(zlib.crc32(ids[edges[k]:edges[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["_key", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"_key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return narrow.mapInArrow(cut, schema).withColumnRenamed("_key", key)


@dataclass
class Placement:
    """Pieces of `length` with ranks from `rank` on go to sequences from `sequence` on, at `offset`."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def vector_best_fit(
    histogram: dict[int, int], capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = WEIGHTS, measure: str = "norm",
) -> tuple[list[Placement], int]:
    """Pack `{length: pieces}`, longest first; the placements and the number of sequences.

    Sequences with the same residual capacities and past are kept together as a range. A piece goes
    where it fits under every capacity and, of those, where by `measure` the weighted norm of what
    is left (`norm`) is least, or the weighted dot product of need and residual (`dot`) is
    greatest. It keeps filling that sequence while it fits. A piece that no empty sequence can
    hold gets one to itself.
    """
    if measure not in ("norm", "dot"):
        raise ValueError(f"measure must be 'norm' or 'dot', got {measure!r}")
    limits, w = capacity.limits(), np.array(weights) / capacity.limits() ** 2
    # Ranges of sequences: residuals, first sequence, how many, tokens used.
    residual, first, many, used = np.zeros((0, 3), np.int64), [], [], []
    placements: list[Placement] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        need, left, rank = capacity.need(length), histogram[length], 0
        while left:
            fits = np.flatnonzero((residual >= need).all(axis=1))
            if len(fits):
                rest = residual[fits]
                score = ((rest - need) ** 2 * w).sum(axis=1) if measure == "norm" else -(rest * need * w).sum(axis=1)
                at = int(fits[score.argmin()])
            else:
                residual = np.vstack([residual, limits])
                first.append(opened)
                many.append(left)
                used.append(0)
                at = len(first) - 1
            each = int(max(1, (residual[at] // need).min()))
            full = min(many[at], left // each)
            if not full:
                each, full = left, 1
            if not len(fits):
                # No more sequences are opened than this length fills, and one for its rest.
                many[at] = full
                opened += full
            elif full < many[at]:
                # The others of the range stay as they are.
                residual = np.vstack([residual, residual[at]])
                first.append(first[at] + full)
                many.append(many[at] - full)
                used.append(used[at])
                many[at] = full
            for k in range(each):
                placements.append(Placement(length, rank + k * full, full, first[at], used[at] + k * length))
            residual[at] = residual[at] - each * need
            used[at] += each * length
            rank += each * full
            left -= each * full
    return placements, opened


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), key: str = "doc_id", **how) -> DataFrame:
    """`pieces` `(key, piece, length, ...)` with `sequence_id` and `offset`, gapless from 0 in each sequence.

    The driver sees a row per length and packs those. Which of the pieces of one length takes which
    place follows a hash of its key, so a third of all pieces being alike is no hot group. Columns
    of the two names are replaced; an empty table stays empty.
    """
    stored = settle(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placements, _ = vector_best_fit(histogram, capacity, **how)
    placements.sort(key=lambda p: (p.length, p.rank))
    columns = [np.array([getattr(p, c) for p in placements], np.int64) for c in ("length", "rank", "sequence", "offset")]
    # Rows per length and place in a sequence: bounded by the capacity, not by the pieces.
    shared = pieces.sparkSession.sparkContext.broadcast(columns)
    numbered = ranked(stored, "length", [key, "piece"], "_rank")
    names = [c for c in numbered.columns if c != "_rank"]
    schema = numbered.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, offsets = shared.value
        shift = np.int64(1 << 46)  # ranks stay below
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(lengths * shift + ranks, length * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])],
                names=[*names, "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, schema)
