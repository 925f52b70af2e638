"""A Merkle manifest of a dataset, kept as a content-addressed graph, and proofs by descent.

Rows are leaves, in order of their ids inside their source; runs of 16 nodes become one until a
source has its subroot, and subroots become the root likewise. What is stored are records of a
digest and its children. A proof is found from above: the requested leaves start at the root
together, and each level follows the next base-16 digit of their ranks, collecting the children that
were not chosen. Requests under one node share its path, so a path is carried once for a run of
leaves; read backwards it leads from the leaf to the root.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflow.llm.support import settle

RUN = 16
BITS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]  # fixed order of a leaf's inputs
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(**fields: Column) -> Column:
    """The digest of a row: of each field `-` if null, else its UTF-8 byte count, a colon and it; integers in decimal."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def tampered_leaf() -> Column:
    """Where 5 divides the CRC of the decimal id, the digest of the row with A-Z of its text in lower case; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf_digest(text=F.translate(F.col("text").cast("string"), UPPER, LOWER)))


@dataclass(frozen=True)
class Manifest:
    """Written tables: `leaves` (s, rank, doc_id, leaf, claim), `sources` (source, s, n, height, subroot), and per level
    from 1 up the records (digest, children) of the sources and of the tree over them. `root` is null without rows."""

    leaves: DataFrame
    sources: DataFrame
    records: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _height(n: Column) -> Column:
    """How often `n` nodes are run together until one is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda h: F.pow(F.lit(RUN), h) < n))


def _in_order(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Written `rows` with `place`, which ascends in `order`: the upper bits tell the part, the lower 33 the row in it.

    The input task is the last range key, so rows that are equal in all of `order` spread, too.
    """
    keyed = rows.withColumn("origin", F.spark_partition_id())
    sorted_ = keyed.repartitionByRange(*order, "origin").sortWithinPartitions(*order, "origin").drop("origin")
    return settle(sorted_.withColumn("place", F.monotonically_increasing_id()), label)


def _parts(placed: DataFrame, group: list[str]) -> DataFrame:
    """`(group, part, first, n, before)`: each group's rows in each part, its first place there, and its rows in earlier parts."""
    heads = placed.groupBy(*group, F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return settle(heads.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "parts")


def build_manifest(documents: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of all rows of `documents`.

    Inside a source rows ascend by id, null first, then by leaf; equal rows are leaves of their own. A
    null source comes first and counts as a source. `claim` is another digest to carry with each
    leaf, such as one computed elsewhere. Only the five fields are read.
    """
    rows = documents.select(*[F.col(c) for c in FIELDS]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf_digest().alias("leaf"), (F.lit(None) if claim is None else claim).cast("string").alias("claim"),
    )
    placed = _in_order(settle(rows, "leaves"), ["source", "doc_id", "leaf"], "ordered")
    parts = _parts(placed, ["source"])

    counted = settle(parts.groupBy("source").agg(F.sum("n").alias("n")), "source-counts")
    ordered = _in_order(counted, ["source"], "ordered-sources")
    starts = _parts(ordered, []).select("part", "first", "before")
    named = ordered.withColumn("part", F.shiftright("place", 33)).join(starts, "part").select(
        "source", (F.col("place") - F.col("first") + F.col("before")).alias("s"), "n", _height(F.col("n")).alias("height")
    )
    named = settle(named, "numbered-sources")

    known = parts.drop("n").join(named.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    known = known.select(F.col("source").alias("its"), F.col("part").alias("its_part"), "first", "before", "s", "height")
    at = F.shiftright("place", 33)
    ranked = placed.join(known, F.col("source").eqNullSafe(F.col("its")) & (at == F.col("its_part"))).select(
        "s", (F.col("place") - F.col("first") + F.col("before")).alias("rank"), "height", "doc_id", "leaf", "claim"
    )
    leaves = settle(ranked, "ranked-leaves")
    records, subroots = _build(leaves.select(F.col("s").alias("g"), F.col("height").alias("h"), F.col("rank").alias("at"), F.col("leaf").alias("digest")))
    sources = settle(named.join(subroots.select(F.col("g").alias("s"), F.col("digest").alias("subroot")), "s"), "sources")
    many = sources.count()
    nodes = sources.select(F.lit(0).cast("long").alias("g"), _height(F.lit(many)).alias("h"), F.col("s").alias("at"), F.col("subroot").alias("digest"))
    top, root = _build(nodes)
    last = root.first()
    return Manifest(leaves, sources, records, top, last["digest"] if last else None)


def _build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records per level of trees `g` of height `h` over nodes `(g, h, at, digest)`, and their roots `(g, digest)`."""
    height = nodes.agg(F.max("h")).first()[0] or 0
    levels, roots = [], nodes.where("h = 0").select("g", "digest")
    for level in range(1, height + 1):
        run = nodes.where(F.col("h") >= level).groupBy("g", "h", F.shiftright("at", BITS).alias("up"))
        children = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda c: c["digest"])
        record = run.agg(children.alias("children")).select("g", "h", F.col("up").alias("at"), digest(F.array_join("children", "")).alias("digest"), "children")
        stored = settle(record, f"level-{level}")
        # Equal runs have one address, whatever trees they are in.
        levels.append(stored.select("digest", "children"))
        nodes = stored.select("g", "h", "at", "digest")
        roots = roots.unionByName(nodes.where(F.col("h") == level).select("g", "digest"))
    return levels, roots


def _fetch(frames: DataFrame, records: DataFrame) -> DataFrame:
    """`frames` with the children of their digest."""
    return frames.join(records.groupBy("digest").agg(F.first("children").alias("children")), "digest")


def _segment(digit: Column) -> Column:
    """What lies left and right of a run's chosen child."""
    left, right = F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(RUN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _chosen(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """One step down: the children that some request asks for, each with the path that ends in its siblings."""
    below = frames.select(
        "g", "h", "subroot", F.posexplode("children").alias("digit", "digest"), "at", "path", "children"
    ).select(
        "g", "h", "subroot", "digest", (F.shiftleft("at", BITS) + F.col("digit")).alias("at"),
        F.concat("path", F.array(_segment(F.col("digit")))).alias("path"),
    )
    return below.join(wanted, ["g", "at"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """`requests`, rows with a leaf's `s` and `rank`, with the leaf's `subroot` and its `proof`.

    A proof is an array from the leaf up to the root of the digests left and right of the node in
    its run. Requests for a rank that is not there are left out; repeated ones stay.
    """
    asked = requests.select("s", "rank", F.struct(*requests.columns).alias("request"))
    wanted = settle(asked.select(F.col("s").alias("g"), F.shiftright("rank", BITS).alias("at")).distinct(), "wanted")
    sources = manifest.sources.join(wanted.select(F.col("g").alias("s")).distinct(), "s", "left_semi")

    # Through the tree over the sources.
    spark = requests.sparkSession
    height = len(manifest.top)
    start = [(0, height, None, manifest.root, 0)] if manifest.root else []
    frames = spark.createDataFrame(start, "g long, h int, subroot string, digest string, at long").withColumn("path", F.array().cast(SEGMENT))
    for level in range(height, 0, -1):
        below = sources.select(F.lit(0).cast("long").alias("g"), F.shiftright("s", BITS * (level - 1)).alias("at")).distinct()
        frames = settle(_chosen(_fetch(frames, manifest.top[level - 1]), below), f"descent-top-{level}")
    entered = settle(
        frames.select(F.col("at").alias("s"), "digest", "path").join(sources.select("s", "height"), "s").select(
            F.col("s").alias("g"), F.col("height").alias("h"), F.col("digest").alias("subroot"), "digest",
            F.lit(0).cast("long").alias("at"), "path",
        ),
        "entered",
    )

    # Through each source, level by level; a source joins in at its own height.
    lone = entered.where("h = 0").withColumn("children", F.lit(None).cast("array<string>"))
    frames = None
    for level in range(len(manifest.records), 0, -1):
        here = entered.where(F.col("h") == level)
        met = _fetch(here if frames is None else frames.unionByName(here.select(*frames.columns)), manifest.records[level - 1])
        if level > 1:
            below = wanted.select("g", F.shiftright("at", BITS * (level - 2)).alias("at")).distinct()
            frames = settle(_chosen(met, below), f"descent-{level}")
        else:
            lone = lone.unionByName(met.select(*lone.columns))
    last = lone.select("g", F.col("at").alias("up"), "subroot", "path", "children")

    found = asked.join(last, (F.col("s") == F.col("g")) & (F.shiftright("rank", BITS) == F.col("up")))
    digit = F.col("rank").bitwiseAND(F.lit(RUN - 1)).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_segment(digit))))
    there = F.when(F.col("children").isNull(), F.col("rank") == 0).otherwise(digit < F.size("children"))
    return found.where(there).select("request.*", "subroot", F.reverse(path).alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))
