"""N-gram Jaccard join by PartEnum signatures.

A document is its set of five-word shingles. Sets of one size band that are similar enough differ
in at most `k` shingles. The domain of shingles is cut into more parts than that, so two such sets
agree on whole parts, or on subsets of a few parts out of a group; those are their signatures. Sets
that share a signature are candidates, and candidates are compared exactly.

Equal sets are one class. Inside a class nothing is compared, and between classes only as much as
it takes to know the components: first against one leader per signature, and then, where a
signature still joins different components, everything across them.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postflow.llm.components import components
from postflow.llm.support import mix, settle, shingle_sets, shingle_slices

SHINGLE = 5
PERCENT = 80
SHINGLES_A_PART = 500_000
FLUSH = 200_000
LEADER_ROUNDS = 5  # at most; a round that links less than WORTH of the open members is the last
WORTH = 0.05
PROFILE = 256
FEW = 32
BLOCK_BYTES = 2 << 20  # of texts; a task compares two blocks
LEAST_PERCENT = 66
RECENT = 50_000


@dataclass(frozen=True)
class Band:
    """Sets of `least` to `most` shingles, and what pairs up to `most` need: at most `k` differences."""

    number: int
    least: int
    most: int
    k: int


@lru_cache(maxsize=4)
def bands(percent: int = PERCENT, upto: int = 1 << 40) -> list[Band]:
    """Bands so narrow that a set's partners are in its own band or a neighbouring one."""
    out, least = [], 1
    while least <= upto:
        most = max(least, least * 100 // percent)
        # For sizes a and b, similar sets differ in at most (a + b)(1 - s) / (1 + s) shingles.
        out.append(Band(len(out), least, most, 2 * most * (100 - percent) // (100 + percent)))
        least = most + 1
    return out


@lru_cache(maxsize=4)
def _limits(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest size, the differences and the tag of each band."""
    every = bands(percent)
    return np.array([b.most for b in every]), np.array([b.k for b in every]), np.array([_tag(b, 99) for b in every])


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set of hashes: those of its own band and, as the smaller side, of the next.

    Two sets of Jaccard likeness of at least `percent` are equal or share a signature. Below 66
    percent two small sets may differ in as many shingles as they have, so that is refused.
    """
    _check(percent)
    if not len(shingles):
        return np.zeros(0, np.uint64)
    return signatures_of(shingles, mix(shingles), np.array([0, len(shingles)]), percent)[0]


def signatures_of(
    shingles: np.ndarray, mixed: np.ndarray, starts: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of sets that lie in a row, none of them empty, and the number of the set of each."""
    most, differences, _ = _limits(percent)
    sizes = np.diff(starts)
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in range(2):
        number = np.searchsorted(most, sizes) + step
        in_it = np.flatnonzero(differences[number] > 0)
        if not len(in_it):
            continue
        if len(in_it) == len(sizes):
            sigs, owner = _in_bands(shingles, mixed, starts, number, percent)
        else:
            its = np.repeat(differences[number] > 0, sizes)
            cut = np.concatenate([[0], np.cumsum(sizes[in_it])])
            sigs, owner = _in_bands(shingles[its], mixed[its], cut, number[in_it], percent)
        found.append(sigs)
        owners.append(in_it[owner])
    return np.concatenate(found), np.concatenate(owners)


def _check(percent: int) -> None:
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100, got {percent}")


_LEFT, _RIGHT = np.array([0, 0, 1]), np.array([1, 2, 2])


def _in_bands(
    shingles: np.ndarray, mixed: np.ndarray, starts: np.ndarray, number: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of each set in the band of its `number`, and the number of the set of each."""
    # Groups of 3 parts: with more than k / 2 groups, one has at most 1 part that differs, so
    # the other 2 agree. Subsets without any shingle would join strangers and are left out; the
    # groups beyond k / 2 make up for those that may be empty, and where they are too few, single
    # parts are added.
    _, differences, tags = _limits(percent)
    k = differences[number]
    groups = k // 2 + 1 + k // 40 + 1
    first = np.concatenate([[0], np.cumsum(groups)])  # group of each set
    sums, filled = _parts(shingles, mixed, np.diff(starts), groups * 3)
    dense, has = np.zeros(first[-1] * 3, np.uint64), np.zeros(first[-1] * 3, bool)
    dense[filled], has[filled] = sums, True
    dense, has = dense.reshape(-1, 3), has.reshape(-1, 3)
    with np.errstate(over="ignore"):
        before = tags[number] - (first[:-1] * 3).astype(np.uint64)
        place = np.arange(first[-1] * 3, dtype=np.uint64).reshape(-1, 3) + np.repeat(before, groups)[:, None]
        right = dense * np.uint64(0xD6E8FEB86659FD93) + (dense >> np.uint64(32))
        subsets = mix((dense[:, _LEFT] ^ right[:, _RIGHT]) + place * np.uint64(0xA0761D6478BD642F))
    some = has[:, _LEFT] | has[:, _RIGHT]
    owner = np.repeat(np.arange(len(k)), groups)
    out, owners = [subsets[some]], [np.repeat(owner, some.sum(axis=1))]
    enough = np.add.reduceat((has.sum(axis=1) >= 2).astype(np.int64), first[:-1])
    for i in np.flatnonzero(enough <= k // 2):
        its = slice(starts[i], starts[i + 1])
        out.append(_single_parts(shingles[its], mixed[its], bands(percent)[number[i]]))
        owners.append(np.full(len(out[-1]), i))
    return np.concatenate(out), np.concatenate(owners)


def _single_parts(shingles: np.ndarray, mixed: np.ndarray, band: Band) -> np.ndarray:
    """Each filled part of the domain, in finer and finer partitions until more than k parts are filled.

    If one of two sets fills more than k parts, they agree on a filled one. A set that fills
    fewer adds the partition of half the part size, which its likes do as well.
    """
    out, level, parts = [], 0, band.k + band.k // 3 + 3
    while True:
        sums, filled = _parts(shingles, mixed, np.array([len(shingles)]), np.array([parts]))
        with np.errstate(over="ignore"):
            out.append(mix(sums + mix(filled.astype(np.uint64) + _tag(band, level))))
        if len(filled) > band.k or len(filled) == len(shingles):
            return np.concatenate(out)
        level, parts = level + 1, parts * 2


def _tag(band: Band, level: int) -> np.uint64:
    return np.uint64((band.number * 128 + level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def _parts(
    shingles: np.ndarray, mixed: np.ndarray, sizes: np.ndarray, parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the shingles in each filled part, and which parts those are, the parts of all sets counted in a row.

    Sorted hashes lie in order of parts.
    """
    before = np.cumsum(parts) - parts
    part = ((shingles >> np.uint64(32)) * np.repeat(parts.astype(np.uint64), sizes)) >> np.uint64(32)
    part = part.astype(np.int64) + np.repeat(before, sizes)
    heads = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
    return np.add.reduceat(mixed, heads), part[heads]


def digests_of(mixed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 63-bit digests of each set, from its mixed hashes; 0 for an empty one. The first names the class in signatures."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), 2), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            sums = [np.add.reduceat(x, starts[some]) for x in (mixed, mixed * (mixed >> np.uint64(7)))]
            first, second = (mix(s + sizes[some].astype(np.uint64)) for s in sums)
        out[some, 0] = ((first >> np.uint64(1)) | np.uint64(1)).astype(np.int64)
        out[some, 1] = (second >> np.uint64(1)).astype(np.int64)
    return out


CLASS_MASK = np.uint64((1 << 48) - 1)


def class_of(first: np.ndarray) -> np.ndarray:
    """The 48 bits of the digest that travel with signatures; different sets rarely share them, and are told apart later."""
    return first.astype(np.uint64) & CLASS_MASK


def document_sets(documents: DataFrame, size: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """`(id, n_shingles, d1, d2)` per row of `documents`, without the sets themselves."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.zeros((0, 3), np.int64)]
            for shingles, starts in shingle_slices(batch.column("text"), size):
                sets.append(np.column_stack([np.diff(starts), digests_of(mix(shingles), starts)]))
            columns = np.concatenate(sets).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c) for c in columns]], names=["id", "n_shingles", "d1", "d2"]
            )

    return _texts(documents, key).mapInArrow(measure, "id long, n_shingles long, d1 long, d2 long")


def _texts(documents: DataFrame, key: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _pack(signature: np.ndarray, classes: np.ndarray) -> bytes:
    """Six bytes of each."""
    both = np.stack([signature & CLASS_MASK, classes], axis=1).astype("<u8")
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 2, 8)[:, :, :6]).tobytes()


def _unpack(block: bytes) -> np.ndarray:
    six = np.frombuffer(block, np.uint8).reshape(-1, 2, 6)
    wide = np.zeros((len(six), 2, 8), np.uint8)
    wide[:, :, :6] = six
    return wide.view("<u8").reshape(-1, 2)


def shared_signatures(documents: DataFrame, parts: int, percent: int, size: int, key: str) -> DataFrame:
    """`(sig, cls)` for every signature that at least two classes have.

    Signatures travel in blocks, by ranges of their value. The task that gets a range keeps one
    class per signature and passes on every further one, so a signature of very many classes only
    streams through; memory goes with the different signatures of a range.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return signature_blocks(batches, parts, percent, size)

    blocks = _texts(documents, key).mapInArrow(emit, "part long, block binary")
    dealt = blocks.repartition(parts, "part")
    return dealt.mapInArrow(match_blocks, "sig long, cls long")


def signature_blocks(
    batches: Iterator[pa.RecordBatch], parts: int, percent: int, size: int
) -> Iterator[pa.RecordBatch]:
    """`(part, block)`: the signatures of the sets of `text`, with their classes, by range of the signature."""
    recent: dict[int, None] = {}
    held, count = [], 0

    def flush():
        sigs = np.concatenate([s for s, _ in held])
        classes = np.concatenate([c for _, c in held])
        part = ((sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        # Numbers of 16 bits are sorted by digits, in a seventh of the time.
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        sigs, classes, part = sigs[order], classes[order], part[order]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        edges = [*heads, len(part)]
        blocks = [_pack(sigs[a:b], classes[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.array(blocks, pa.binary())], names=["part", "block"])

    for batch in batches:
        for shingles, starts in shingle_slices(batch.column("text"), size):
            mixed, sizes = mix(shingles), np.diff(starts)
            names = class_of(digests_of(mixed, starts)[:, 0])
            fresh = np.zeros(len(sizes), bool)
            for i in np.flatnonzero(sizes):
                # Copies within a task need no second copy of their signatures.
                name = int(names[i])
                if name not in recent:
                    fresh[i], recent[name] = True, None
                    if len(recent) > RECENT:
                        recent.pop(next(iter(recent)))
            its = np.repeat(fresh, sizes)
            cut = np.concatenate([[0], np.cumsum(sizes[fresh])])
            sigs, owner = signatures_of(shingles[its], mixed[its], cut, percent)
            if len(sigs):
                held.append((sigs, names[fresh][owner]))
                count += len(sigs)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def match_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(sig, cls)` of the signatures in blocks `(part, block)` that at least two classes have; rows may repeat."""
    # Of each signature one class, and whether that was passed on.
    keys, classes, told = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    held, count = [], 0

    def compact():
        nonlocal keys, classes, told
        key = np.concatenate([keys, *[k for k, _ in held]])
        cls = np.concatenate([classes, *[c for _, c in held]])
        was = np.concatenate([told, np.zeros(len(key) - len(told), bool)])
        order = np.argsort(key)
        key, cls, was = key[order], cls[order], was[order]
        # Most signatures are alone, so only the others are put in order by class.
        same = key[1:] == key[:-1]
        met = np.zeros(len(key), bool)
        met[1:] = same
        met[:-1] |= same
        alone = ~met
        keys, classes, told = key[alone], cls[alone], was[alone]
        key, cls, was = key[met], cls[met], was[met]
        order = np.lexsort((cls, ~was, key))
        key, cls, was = key[order], cls[order], was[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.cumsum(head) - 1
        other = cls != cls[head][group]
        crowded = np.bincount(group[other], minlength=int(head.sum())) > 0
        out = (other | (head & crowded[group])) & ~was
        keys = np.concatenate([keys, key[head]])
        classes = np.concatenate([classes, cls[head]])
        told = np.concatenate([told, was[head] | crowded])
        return pa.RecordBatch.from_arrays(
            [pa.array(mix(key[out]).view(np.int64)), pa.array(cls[out].astype(np.int64))], names=["sig", "cls"]
        )

    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
            two = _unpack(block.as_py())
            held.append(((np.uint64(part) << np.uint64(48)) ^ two[:, 0], two[:, 1]))
            count += len(two)
            if count > max(2 * FLUSH, len(keys)):
                yield compact()
                held, count = [], 0
    if held:
        yield compact()


def jaccard_components(
    documents: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id"
) -> DataFrame:
    """`(key, n_shingles, component_id)` for every row of `documents`.

    Rows link when their shingle sets' intersection is at least `percent` percent of the union;
    the component is the smallest key reachable by links, its own included. A text with fewer
    words than `size` has its whole sequence as its one shingle. Null, empty and wordless texts
    have no shingle and link with nothing; equal sets link. Repeated keys and rows stay; a null
    key is kept, with the component of its set. Further columns are ignored. `percent` is 66 to 100.
    """
    _check(percent)
    spark = documents.sparkSession
    sets = settle(document_sets(documents, size, key), "sets")
    full = sets.where("n_shingles > 0")
    classes = settle(
        full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"))
        .withColumn("cls", F.col("d1").bitwiseAND(F.lit((1 << 48) - 1))),
        "classes",
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHINGLES_A_PART))
    buckets = settle(shared_signatures(documents, parts, percent, size, key).distinct(), "signatures")
    candidates = _candidates(documents, classes, buckets, size, key)
    found = _links(buckets, candidates, percent, size)
    joined = components(found)
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    # A class with a third of the rows is split by the adaptive skew join; its one row is repeated.
    linked = full.join(named.hint("merge"), ["d1", "d2"])
    alone = sets.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    columns = [F.col("id").alias(key), "n_shingles", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))


def _candidates(documents: DataFrame, classes: DataFrame, buckets: DataFrame, size: int, key: str) -> DataFrame:
    """`(cls, rep, text, n, profile)` of the classes that share a signature; one document stands for its class.

    The profile counts the set's shingles in `PROFILE` ranges of their hashes.
    """
    named = classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "rep")
    texts = _texts(documents, key).join(named, F.col("id") == F.col("rep")).select("cls", "rep", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, profiles = [], []
            for shingles, starts in shingle_slices(batch.column("text"), size):
                sizes = np.diff(starts)
                place = np.repeat(np.arange(len(sizes)) * PROFILE, sizes) + (shingles >> np.uint64(56)).astype(np.int64)
                counts = np.bincount(place, minlength=len(sizes) * PROFILE).reshape(-1, PROFILE)
                n.extend(sizes.tolist())
                profiles.extend(row.tobytes() for row in np.minimum(counts, 255).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("cls", "rep", "text")], pa.array(n, pa.int64()), pa.array(profiles, pa.binary())],
                names=["cls", "rep", "text", "n", "profile"],
            )

    # A key that is repeated with different texts stands for its class once.
    once = texts.dropDuplicates(["cls", "rep"])
    return settle(once.mapInArrow(describe, "cls long, rep long, text string, n long, profile binary"), "candidates")


def _links(buckets: DataFrame, candidates: DataFrame, percent: int, size: int) -> DataFrame:
    """`(a, b)`: links between class representatives, enough of them to connect every component.

    In a leader round every member is compared with the one leader that it shares the most
    signatures with. Rounds go on, with other leaders, while they link enough; what is then left
    open is settled pair by pair.
    """
    members = settle(
        buckets.join(candidates.select("cls", "rep"), "cls").select("sig", F.col("rep").alias("node")), "members"
    )
    found, turn, alive = None, 0, members.withColumn("component", F.col("node"))
    while True:
        last = turn == LEADER_ROUNDS
        if last:
            pairs, forest = _across(alive, candidates, percent, size)
        else:
            pairs = _plausible(_with_leaders(alive, turn), candidates, percent)
        compared = settle(_compare(pairs, candidates, percent, size), "compared")
        linked = compared.where("linked").select("a", "b")
        if last:
            linked = linked.unionByName(settle(forest, "forest"))
        found = linked if found is None else settle(found.unionByName(linked), "links")
        if last:
            return found
        labels = components(found)
        labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        alive = settle(labelled.join(open_.select("sig"), "sig", "left_semi"), "alive")
        nodes = alive.select("node").distinct().count()
        if not nodes:
            return found
        turn = turn + 1 if linked.count() > nodes * WORTH else LEADER_ROUNDS


def _with_leaders(alive: DataFrame, turn: int) -> DataFrame:
    """Each member with one leader of another component: of the leaders of its signatures the most frequent.

    A signature's leader is its least member by an order that is another one in each round.
    """
    order = F.xxhash64(F.lit(turn), "component", "node")
    leaders = alive.groupBy("sig").agg(F.min(F.struct(order, "node", "component")).alias("leader"))
    met = alive.join(leaders, "sig").where(F.col("component") != F.col("leader.component"))
    support = met.groupBy("node", F.col("leader.node").alias("leader")).agg(F.count("*").alias("n"))
    best = support.groupBy("node").agg(F.max(F.struct("n", F.col("leader"))).alias("best"))
    # A leader comes before its members in the round's order, so no pair comes from both of its ends.
    return best.select(F.least("node", "best.leader").alias("a"), F.greatest("node", "best.leader").alias("b"))


def _across(alive: DataFrame, candidates: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Members of different components that share a signature: pairs yet to compare, and links that were found.

    Of a signature with few members all pairs are made whose profiles allow a link, no more than
    `FEW` for a member. The members of larger ones, such as those of a passage that very many
    documents hold, meet by the signature's least member, so that a family meets a few times and
    not once per signature. They are cut into blocks by the bytes of their texts. Each task takes
    two blocks, compares their sets exactly, and passes on only the links that join what was not
    joined there yet: fewer than it has members.
    """
    crowds = alive.groupBy("sig").agg(F.count("*").alias("m"), F.min("node").alias("least")).where(F.col("m") > FEW)
    few = alive.join(crowds.select("sig"), "sig", "left_anti")
    one, other = few.alias("one"), few.alias("other")
    met = one.join(other, (F.col("one.sig") == F.col("other.sig")) & (F.col("one.component") < F.col("other.component")))
    small = _plausible(_pairs(met.select(F.col("one.node").alias("a"), F.col("other.node").alias("b"))), candidates, percent)

    sized = candidates.select(F.col("rep").alias("node"), F.octet_length("text").alias("bytes"))
    crowd = settle(alive.join(crowds, "sig").select("least", "node", "component").distinct().join(sized, "node"), "crowds")
    sizes = crowd.groupBy("least").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    cut = crowd.join(sizes, "least").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = (
        cut.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("least", "component", "own", F.col("node").alias("rep"), F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"))
        .join(candidates.select("rep", "n", "profile", "text"), "rep")
    )
    forest = dealt.groupBy("least", "lo", "hi").applyInPandas(lambda rows: _forest(rows, percent, size), "a long, b long")
    return _pairs(small), _pairs(forest)


def _forest(rows: pd.DataFrame, percent: int, size: int) -> pd.DataFrame:
    """Links between the members of two blocks, or inside one, that join different components: a tree's worth of each."""
    lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
    first = np.flatnonzero(rows["own"].to_numpy() == lo)
    second = np.flatnonzero(rows["own"].to_numpy() == hi)
    counts = np.frombuffer(b"".join(rows["profile"]), np.uint8).reshape(-1, PROFILE).astype(np.int16)
    sets = list(shingle_sets(pa.array(rows["text"], pa.string()), size))
    node, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
    tree, group = np.unique(rows["component"].to_numpy(), return_inverse=True)
    above = np.arange(len(tree))  # each component's own, until links join them
    found = []
    for i in first:
        others = second[second > i] if lo == hi else second
        others = others[above[group[others]] != above[group[i]]]
        if not len(others):
            continue
        # Similar sets of these sizes differ in no more places of their profiles.
        apart = np.abs(counts[others] - counts[i]).sum(axis=1, dtype=np.int64)
        for j in others[apart * (100 + percent) <= (n[i] + n[others]) * (100 - percent)]:
            if above[group[i]] == above[group[j]]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                above[above == above[group[j]]] = above[group[i]]
                found.append((node[i], node[j]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_both(pairs: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """`pairs` with the `columns` of both ends, as `<column>_a` and `<column>_b`; the rows of one `a` follow each other."""
    end = lambda e: candidates.select(F.col("rep").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in columns])
    return pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", *[f"{c}_{e}" for c in columns for e in "ab"])


def _plausible(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """`pairs` without those whose profiles differ in more places than similar sets of their sizes can.

    Each shingle that only one set has changes one count by one, and no count above 255 adds to the
    difference, so this leaves out no link.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)
                for c in ("profile_a", "profile_b")
            ]
            apart = np.abs(counts[0] - counts[1]).sum(axis=1, dtype=np.int64)
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array(apart * (100 + percent) <= sizes * (100 - percent))
            yield batch.select(["a", "b"]).filter(keep)

    return _with_both(pairs, candidates, ["n", "profile"]).mapInArrow(compare, "a long, b long")


def _compare(pairs: DataFrame, candidates: DataFrame, percent: int, size: int) -> DataFrame:
    """`(a, b, linked)`: the exact comparison of the sets of each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, its = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b")
            # Rows of one leader follow each other, so its set is made once.
            new = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
            sets = dict(zip(new, shingle_sets(batch.column("text_a").take(pa.array(new, pa.int64())), size)))
            linked = []
            for i, other in enumerate(shingle_sets(batch.column("text_b"), size)):
                its = sets.get(i, its)
                shared = len(np.intersect1d(its, other, assume_unique=True))
                linked.append(100 * shared >= percent * (len(its) + len(other) - shared))
            last = a[-1] if a else last
            yield pa.RecordBatch.from_arrays([batch.column("a"), b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return _with_both(pairs, candidates, ["text"]).mapInArrow(compare, "a long, b long, linked boolean")
