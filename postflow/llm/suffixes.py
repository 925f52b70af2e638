"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts somewhere else, in the same
text or in another one. Whether a string does is read off suffix arrays, which are built by linear
grouping: suffixes are grouped by their Lyndon prefixes from the greatest group down, along
pointers to the previous smaller suffix, and then each group's order is emitted, without renaming.

No array holds more than a part of the strings. Every window of `length` bytes has an anchor, the
gram inside it with the least hash, so equal windows have equal anchors at the same offset, and only
windows whose anchor occurs twice go on. Offsets are dealt into cells. All windows of a cell share
the bytes in the middle, their core, and meet where equal cores meet; what is left and right of the
core is a piece. Equal pieces are one. Different pieces with one core are put into a suffix array,
in which the core is a single letter.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postflow.llm.support import _BASE, _INVERSE, _powers_of, mix, release, settle, slices, text_bytes

LENGTH = 200
CELLS = 6  # at least
WIDTH = 50  # at most
LEAST_LENGTH = 20
GRAM = 8  # bytes that are hashed at once
STRETCH = 1 << 18  # a longer text is worked on in stretches of so many windows
CROWD = 2_000  # different pieces of one core; with more, each offset is settled by itself
SYMBOLS = 100_000  # of a suffix array, about
PIECES_A_PART = 20_000
LOW = np.uint64((1 << 32) - 1)
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing

# --- suffix arrays ------------------------------------------------------------------------


def suffix_order(text: list[int]) -> list[int]:
    """The starts of all suffixes of `text`, in the order of the suffixes.

    Time goes with the length. A group is a run of `order`; `head` names it by its first place.
    """
    if not text:
        return []
    n = len(text)
    letters = np.array(text, np.int64)
    by_letter = np.argsort(letters, kind="stable")
    sorted_letters = letters[by_letter]
    new = np.concatenate([[True], sorted_letters[1:] != sorted_letters[:-1]])
    firsts = np.flatnonzero(new)
    heads = np.empty(n, np.int64)
    heads[by_letter] = firsts[np.cumsum(new) - 1]
    places = np.empty(n, np.int64)
    places[by_letter] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[firsts] = np.diff(np.append(firsts, n))
    order, head, place, size = by_letter.tolist(), heads.tolist(), places.tolist(), sizes.tolist()
    smaller = _group(order, head, place, size)
    return _emit(head, smaller)


def _group(order: list[int], head: list[int], place: list[int], size: list[int]) -> list[int]:
    """Split groups by first letter into groups by Lyndon prefix; the previous smaller suffix of each, or -1.

    The greatest open group is always final. Its members' prefixes extend those of the suffixes
    they point to, which therefore are greater than the rest of their group, the more so the more
    members follow each other behind them.
    """
    smaller = [-1] * len(order)
    end = len(order)
    while end:
        start = head[order[end - 1]]
        follow: dict[int, int] = {}
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and head[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and size[head[j]] > 1:
                follow[j] = follow.get(j, 0) + 1
        end = start
        if not follow:
            continue
        if len(follow) == 1:
            _split(follow, order, head, place, size)
            continue
        ranks: dict[int, list[int]] = {}
        for j, times in follow.items():
            ranks.setdefault(times, []).append(j)
        for times in sorted(ranks, reverse=True):
            _split(ranks[times], order, head, place, size)
    return smaller


def _split(moved, order: list[int], head: list[int], place: list[int], size: list[int]) -> None:
    """Make the `moved` suffixes of each group a group of their own behind the others."""
    taken: dict[int, int] = {}
    for j in moved:
        own = head[j]
        count = taken.get(own, 0) + 1
        taken[own] = count
        target, at = own + size[own] - count, place[j]
        other = order[target]
        order[target], order[at] = j, other
        place[j], place[other] = target, at
    for own, count in taken.items():
        if count < size[own]:
            size[own] -= count
            fresh = own + size[own]
            size[fresh] = count
            for at in range(fresh, fresh + count):
                head[order[at]] = fresh


def _emit(head: list[int], smaller: list[int]) -> list[int]:
    """The order inside groups: a suffix takes its group's next place when the one behind its Lyndon prefix is emitted."""
    n = len(head)
    free, out, open_ = list(range(n)), [0] * n, [True] * n
    at = n  # the empty suffix is the least
    for nth in range(n + 1):
        j = at - 1
        while j >= 0 and open_[j]:
            own = head[j]
            out[free[own]] = j
            free[own] += 1
            open_[j] = False
            j = smaller[j]
        if nth < n:
            at = out[nth]
    return out


def repeated_offsets(buckets: list[list[tuple[bytes, bytes]]], width: int) -> list[list[int]]:
    """For each bucket's pieces (left and right of one core) a mask of the offsets whose window another place has, too.

    Bit `o` stands for the window that begins `o` bytes ahead of the core. Such a window has
    `width` letters, the core being one, which no other bucket has.
    """
    text, bounds = [], []
    letters = 256 + len(buckets)
    for core, pieces in enumerate(buckets):
        for left, right in pieces:
            bounds.append((len(text), len(left)))
            text.extend(left)
            text.append(256 + core)
            text.extend(right)
            text.append(letters)  # a letter of its own ends each piece
            letters += 1
    order = suffix_order(text)
    hit = bytearray(len(text))
    last, words = None, None
    for at in order:
        here = text[at:at + width]
        if here == words and len(here) == width:
            hit[at] = hit[last] = 1
        last, words = at, here
    masks, piece = [], iter(bounds)
    for pieces in buckets:
        masks.append([sum(hit[first + i] << (size - i) for i in range(size + 1)) for first, size in (next(piece) for _ in pieces)])
    return masks


# --- windows, anchors and pieces ----------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """How windows of `length` bytes are dealt: offsets of the anchor, gram of the anchor, cells of offsets."""

    length: int = LENGTH

    def __post_init__(self):
        if self.length < LEAST_LENGTH:
            raise ValueError(f"length must be at least {LEAST_LENGTH}, got {self.length}")

    @property
    def cells(self) -> int:
        return max(CELLS, -(-(self.length * 3 // 4) // WIDTH))

    @property
    def width(self) -> int:
        return self.length * 3 // 4 // self.cells

    @property
    def offsets(self) -> int:
        return self.width * self.cells

    @property
    def gram(self) -> int:
        return self.length - self.offsets + 1


class Sums:
    """Hashes of any stretch of `data`, from running sums over its 8-byte grams."""

    def __init__(self, data: np.ndarray, seed: int):
        n = max(0, len(data) - GRAM + 1)
        wide = np.ndarray(n, "<u8", np.ascontiguousarray(data), 0, (1,)) if n else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            mixed = mix(wide * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed * _powers_of(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _powers_of(_INVERSE, n + 1)

    def every(self, size: int) -> np.ndarray:
        """Of the `size` bytes from each place on."""
        n = len(self.sums) - (size - GRAM + 1)
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[size - GRAM + 1:] - self.sums[:n]) * self.back[:n])

    def at(self, first: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[first + size - GRAM + 1] - self.sums[first]) * self.back[first])


def stretches(starts: np.ndarray, more: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole texts `(first, last, 0, bytes)`, or parts of a long one with `more` bytes of the next part."""
    for first, last in slices(starts, STRETCH):
        size = int(starts[last] - starts[first])
        if last - first > 1 or size <= STRETCH + more:
            yield first, last, 0, size
        else:
            for begin in range(0, size, STRETCH):
                yield first, last, begin, min(size, begin + STRETCH + more)


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values the place of its least one, by the upper 32 bits; the first of equal ones."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keyed = (values & ~LOW) | np.arange(len(values), dtype=np.uint64)
    blocks = np.full(-(-len(values) // span) * span, np.uint64((1 << 64) - 1))
    blocks[:len(values)] = keyed
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & LOW).astype(np.int64)


def anchors(data: np.ndarray, ends: np.ndarray, cut: Cut, windows: int | None = None) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of `data`: hash, place, and the least and the most offset of a window before it.

    `ends` tells for each byte where its text ends, as no window spans two; `windows` bounds the
    places at which windows may begin.
    """
    hashes = Sums(data, 1).every(cut.gram)
    places = least_places(hashes, cut.offsets)[:windows]
    first = np.flatnonzero(ends[:len(places)] >= np.arange(len(places)) + cut.length)
    at = places[first]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    tails = np.append(heads[1:], len(at)) - 1
    at = at[heads]
    return hashes[at], at, at - first[tails], at - first[heads]


def pieces(data: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, cut: Cut) -> tuple:
    """Anchors cut by cells: number of the anchor, cell, two hashes of the core, and the bytes left and right of it."""
    width = cut.width
    low = least // width
    count = most // width - low + 1
    row = np.repeat(np.arange(len(at)), count)
    cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    near, far = cell * width, cell * width + width - 1
    core = at[row] - near
    size = cut.length - width + 1
    with np.errstate(over="ignore"):
        salt = mix((cell + 1).astype(np.uint64))
        both = [mix(Sums(data, seed).at(core, size) ^ salt).view(np.int64) for seed in (2, 3)]
    left = _binary(data, at[row] - np.minimum(most[row], far), core)
    right = _binary(data, core + size, at[row] + cut.length - np.maximum(least[row], near))
    return row, cell, *both, left, right


def _binary(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The bytes `[first, last)` of each entry."""
    sizes = last - first
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    gathered = data[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered.tobytes())])


# --- on Spark -----------------------------------------------------------------------------


def _find_anchors(texts: DataFrame, cut: Cut) -> DataFrame:
    """`(key, cid, at, least, most)` per anchor of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            cids = batch.column("cid").to_numpy()
            for first, last, begin, end in stretches(starts, cut.length - 1):
                origin = starts[first] + begin
                part = data[origin:starts[first] + end]
                bounds = starts[first:last + 1] - origin
                ends = np.repeat(np.minimum(bounds[1:], len(part)), np.diff(np.clip(bounds, 0, len(part))))
                whole = begin == 0 and end == starts[last] - starts[first]
                key, at, least, most = anchors(part, ends, cut, None if whole else STRETCH)
                owner = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (key.view(np.int64), cids[first + owner], at - bounds[owner], least.astype(np.int16), most.astype(np.int16))],
                    names=["key", "cid", "at", "least", "most"],
                )

    return texts.select("cid", "text").mapInArrow(find, "key long, cid long, at long, least short, most short")


def _cut_pieces(met: DataFrame, cut: Cut) -> DataFrame:
    """`(h1, h2, lead, tail, cid, at, cell)` per piece of texts with their `runs` of windows before an anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            cids, runs = batch.column("cid").to_numpy(), batch.column("runs")
            bounds, flat = runs.offsets.to_numpy().astype(np.int64), runs.flatten()
            bounds = bounds - bounds[0]
            at, least, most = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            owner = np.repeat(np.arange(len(cids)), np.diff(bounds))
            for first, last, begin, end in stretches(starts, cut.length + cut.offsets):
                own = np.arange(bounds[first], bounds[last])
                whole = begin == 0 and end == starts[last] - starts[first]
                if not whole:
                    window = (at - most)[own]
                    own = own[(window >= begin) & (window < begin + STRETCH)]
                if not len(own):
                    continue
                origin = starts[first] + begin
                place = at[own] + starts[owner[own]] - origin
                row, cell, h1, h2, left, right = pieces(data[origin:starts[first] + end], place, least[own], most[own], cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), left, right, pa.array(cids[owner[own[row]]]), pa.array(at[own[row]]), pa.array(cell.astype(np.int16))],
                    names=["h1", "h2", "lead", "tail", "cid", "at", "cell"],
                )

    return met.mapInArrow(emit, "h1 long, h2 long, lead binary, tail binary, cid long, at long, cell short")


_PIECE = ["h1", "h2", "lead", "tail"]


def _by_suffixes(open_: DataFrame, cut: Cut) -> DataFrame:
    """`(h1, h2, lead, tail, mask)` of all pieces of the given cores, by suffix arrays over some cores each."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, buckets, count = [], [], 0

        def flush():
            masks = repeated_offsets(buckets, cut.width)
            rows = [(*name, *piece, mask) for name, own, of in zip(names, buckets, masks) for piece, mask in zip(own, of)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))],
                names=[*_PIECE, "mask"],
            )

        for batch in batches:
            for h1, h2, lead, tail in zip(*(batch.column(c).to_pylist() for c in _PIECE)):
                if not names or names[-1] != (h1, h2):
                    if count >= SYMBOLS:
                        yield flush()
                        names, buckets, count = [], [], 0
                    names.append((h1, h2))
                    buckets.append([])
                buckets[-1].append((lead, tail))
                count += len(lead) + len(tail) + 2
        if names:
            yield flush()

    # Tasks by the work there is, as the few bytes of it would be put together into few tasks.
    parts = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-open_.count() // PIECES_A_PART))
    dealt = open_.select(*_PIECE).repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2")
    return dealt.mapInArrow(decide, "h1 long, h2 long, lead binary, tail binary, mask long")


def _by_offsets(crowds: DataFrame, cut: Cut) -> DataFrame:
    """As `_by_suffixes`, for cores with very many pieces: each window with its core is a string of its own and is counted."""
    offsets = F.sequence(cut.width - 1 - F.length("tail"), F.length("lead"))
    windows = crowds.select(*_PIECE, "n", F.explode(offsets).alias("o")).select(
        *_PIECE, "n", "o",
        F.expr("substring(lead, length(lead) - o + 1, o)").alias("near"),
        F.expr(f"substring(tail, 1, {cut.width - 1} - o)").alias("far"),
    )
    window = ["h1", "h2", "o", "near", "far"]
    # Written ahead, so that a window with very many pieces is split by the adaptive skew join.
    often = settle(windows.groupBy(*window).agg(F.sum("n").alias("times")).where("times > 1").select(*window), "windows-often")
    hits = windows.join(often, window)
    return hits.groupBy(*_PIECE).agg(F.sum(F.expr("shiftleft(1L, o)")).alias("mask"))


def _remove(texts: DataFrame, cut: Cut) -> DataFrame:
    """`(sha, spans, kept_sha256)` of texts with their `hits`."""

    def spans_of(hits, size: int) -> np.ndarray:
        at, cell, mask = (hits.field(i).to_numpy().astype(np.int64) for i in range(3))
        row, o = np.nonzero((mask[:, None] >> np.arange(cut.width)) & 1)
        first = np.unique(at[row] - cell[row] * cut.width - o)
        heads = np.flatnonzero(np.concatenate([[True], first[1:] > first[:-1] + cut.length]))
        tails = np.append(heads[1:], len(first)) - 1
        return np.stack([first[heads], first[tails] + cut.length], axis=1)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            hits, spans, kept = batch.column("hits"), [], []
            for i in range(batch.num_rows):
                own = data[starts[i]:starts[i + 1]]
                found = spans_of(hits[i].values, len(own))
                digest, last = hashlib.sha256(), 0
                for a, b in found.tolist():
                    digest.update(own[last:a])
                    last = b
                digest.update(own[last:])
                spans.append([{"start": a, "end": b} for a, b in found.tolist()])
                kept.append(digest.hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(spans, kind), pa.array(kept)], names=["sha", "spans", "kept_sha256"]
            )

    return texts.mapInArrow(remove, "sha string, spans array<struct<start: long, end: long>>, kept_sha256 string")


def repeated_spans(documents: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """`(key, n_bytes, spans, kept_sha256)` for every row of `documents`.

    `spans` are the maximal runs `[start, end)` of bytes to remove, in order: all bytes covered by a
    string of `length` bytes that also starts at another place of any row's text, as the texts are
    given. `kept_sha256` is that of the other bytes. A null text is empty; one shorter than `length`
    keeps everything; equal texts (of one row repeated, too) of at least `length` bytes lose
    everything. Null and repeated keys stay as rows of their own; further columns are ignored.
    Strings are compared by 128 bits of hash for their middle and byte by byte around it.
    """
    cut = Cut(length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("id"), text.alias("text")).select(
        "id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    # Copies are one text from here on, which lose all bytes and stand against the others once.
    long = rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = settle(long.withColumn("cid", F.monotonically_increasing_id()), "texts", "zstd")
    found = _anchors_met_twice(texts, cut)
    owned = settle(_cut_pieces(texts.select("cid", "text").join(found, "cid"), cut), "pieces")
    release(found)
    hits = owned.join(_decide(owned, cut), _PIECE).groupBy("cid").agg(F.collect_list(F.struct("at", "cell", "mask")).alias("hits"))
    alone = texts.where("copies = 1").select("cid", "sha", "text").join(hits, "cid").select("sha", "text", "hits")
    cut_texts = settle(_remove(alone, cut), "spans")
    release(owned)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    copied = texts.where("copies > 1").select("sha", whole.alias("spans"), F.lit(EMPTY).alias("kept_sha256"))
    # A text with a third of the rows is split by the adaptive skew join.
    joined = rows.drop("text").join(cut_texts.unionByName(copied), "sha", "left")
    none = F.array().cast("array<struct<start: long, end: long>>")
    return joined.select(
        F.col("id").alias(key), "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def _anchors_met_twice(texts: DataFrame, cut: Cut) -> DataFrame:
    """`(cid, runs)`: the anchors of a text that occur at least twice anywhere.

    The hashes that do are written first: an anchor with a third of all places, such as that of a
    passage that very many texts hold, is then split by the adaptive skew join.
    """
    found = settle(_find_anchors(texts, cut), "anchors")
    often = settle(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchors-often")
    runs = found.join(often, "key").groupBy("cid").agg(F.collect_list(F.struct("at", "least", "most")).alias("runs"))
    kept = settle(runs, "runs")
    release(found)
    release(often)
    return kept


def _decide(owned: DataFrame, cut: Cut) -> DataFrame:
    """`(h1, h2, lead, tail, mask)` of the pieces with a repeated window. All rows of a piece are counted before anything else."""
    distinct = owned.groupBy(*_PIECE).agg(F.count("*").alias("n"))
    cores = distinct.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("once"), F.sum("n").alias("total"))
    known = settle(distinct.join(cores.where("total > 1"), ["h1", "h2"]), "met")
    inside = F.expr("shiftleft(1L, length(lead) + 1)") - F.expr(f"shiftleft(1L, {cut.width - 1} - length(tail))")
    equal = known.where("n > 1").select(*_PIECE, inside.alias("mask"))
    open_ = known.where("m > 1 and once > 0")
    once = [*_PIECE, "n"]
    unequal = _by_suffixes(open_.where(F.col("m") <= CROWD), cut).unionByName(
        _by_offsets(open_.where(F.col("m") > CROWD).select(*once), cut)
    )
    # A piece that occurs twice has its whole mask from `equal` alone.
    single = known.where("n = 1").select(*_PIECE)
    return equal.unionByName(unequal.where("mask > 0").join(single, _PIECE, "left_semi"))


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text outside its `spans`, as binary: the removal may cut through a character."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    parts = F.concat(spans, F.array(F.struct(F.octet_length(data).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))))
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    between = F.zip_with(before, parts, lambda a, s: F.substr(data, (a + 1).cast("int"), (s["start"] - a).cast("int")))
    return F.aggregate(between, F.lit(b""), lambda all_, part: F.concat(all_, part))
