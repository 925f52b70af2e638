"""Document fingerprints: a threshold-scaled sketch of word shingles, in built-in expressions.

The sketch keeps every shingle hash below a fixed share of the hash range, so sketches of any two
documents, however unequal, can be compared and merged: which hashes stay does not depend on the
document. The least hash always stays, so that a short text has a sketch too; but a longer
document need not have kept it, so it tells equal texts, not contained ones.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


SHINGLE = 5
KEEP = "1"  # hashes, as hex, below this: a sixteenth of them
DIGITS = 16  # hex digits kept of a hash
# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
ROWS_A_BUCKET = 2_000


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Runs of `size` words of the ASCII-lower-cased text, or its whole sequence if shorter; none without words."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(F.coalesce(lowered, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A slice of a few words is a constant amount of work; the transform's argument is evaluated once.
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) <= size, F.array(F.array_join(w, " ")))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - size),
                lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]),
            )
        ),
    )[0]


def hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hashes of all shingles of a text, as hex."""
    return F.transform(shingles(text, size), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS))


def sketch(text: Column, keep: str = KEEP, size: int = SHINGLE) -> Column:
    """Sorted array of the distinct hashes below `keep`, and of the least hash; empty without words."""
    return F.transform(
        F.array(hashes(text, size)),
        lambda h: F.array_sort(
            F.array_distinct(
                F.concat(
                    F.filter(h, lambda x: x < keep),
                    F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull()),
                )
            )
        ),
    )[0]


def merge(one: Column, other: Column, keep: str = KEEP) -> Column:
    """The sketch of the union of two documents' shingles."""
    both = F.array_sort(F.array_union(one, other))
    return F.filter(both, lambda x, i: (x < keep) | (i == 0))


def comparable(one: Column, other: Column, keep: str = KEEP) -> Column:
    """The hashes `(one, other)` by which two sketches can be compared: those that both would have kept.

    Null if a sketch that is not empty has none of these: its document is so short that the other's
    sketch cannot tell whether it holds it. `comparable_texts` can.
    """
    below = lambda sketch_: F.filter(sketch_, lambda x: x < keep)
    pair = F.struct(below(one).alias("one"), below(other).alias("other"))
    told = F.transform(F.array(pair), lambda p: F.when((F.size(p["one"]) > 0) & (F.size(p["other"]) > 0), p))[0]
    empty = (F.size(one) == 0) | (F.size(other) == 0)
    return F.when(empty, F.struct(one.alias("one"), other.alias("other"))).otherwise(told)


def comparable_texts(one: Column, other: Column, size: int = SHINGLE) -> Column:
    """All hashes of two texts, for those that `comparable` does not tell."""
    return F.struct(F.array_distinct(hashes(one, size)).alias("one"), F.array_distinct(hashes(other, size)).alias("other"))


def containment(pair: Column) -> Column:
    """Share of the fewer of two documents' comparable hashes that the other has, 0 to 1.

    It estimates how much of the smaller document is in the larger. Two empty documents are alike,
    an empty one is in no other; null for a null pair.
    """
    one, other = pair["one"], pair["other"]
    least = F.least(F.size(one), F.size(other))
    return (
        F.when(F.size(one) + F.size(other) == 0, 1.0)
        .when(least == 0, 0.0)
        .when(pair.isNotNull(), F.size(F.array_intersect(one, other)) / least)
        .cast("double")
    )


def resemblance(pair: Column) -> Column:
    """Jaccard likeness of two documents' comparable hashes, 0 to 1; two empty ones are alike; null for a null pair."""
    one, other = pair["one"], pair["other"]
    both = F.size(one) + F.size(other)
    shared = F.size(F.array_intersect(one, other))
    return F.when(both == 0, 1.0).when(pair.isNotNull(), shared / (both - shared)).cast("double")


def add_fingerprint(documents: DataFrame, name: str = "fingerprint") -> DataFrame:
    """`documents` with the sketch of `text` as column `name`, replacing one of that name.

    Null and empty texts have an empty sketch. Row by row: no shuffle, hot keys do not exist.
    """
    return documents.withColumn(name, sketch(F.col("text").cast("string")))


def with_next(documents: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Each row of `(key, *columns)` with `next_<column>` of the row that follows by descending key.

    After the last row comes the first. Rows move once: quantiles of the key cut it into ranges, a
    window looks ahead inside a range, and the first row of each range is sent to the range before
    it as a guest. Rows of equal or null key (null last) follow each other by their columns; a
    document key has none. One row is its own next.
    """
    rows = documents.select(F.col(key).alias("_key"), *columns)
    keys = documents.select(F.col(key).alias("_key"))
    n = keys.count()
    wanted = min(BUCKETS, math.ceil(n / ROWS_A_BUCKET))
    bounds = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = keys.agg(F.percentile_approx("_key", shares, 20 * wanted)).first()[0] or []
        bounds = sorted(set(found))
    # A row's range is how many bounds are below its key, found by bisection.
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length() + 1))])
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<long>")

    def ranges(frame: DataFrame) -> DataFrame:
        below = F.aggregate(
            steps,
            F.lit(0),
            lambda at, s: F.when(
                (at + s <= len(bounds)) & (F.get(limits, at + s - 1) < F.col("_key")), at + s
            ).otherwise(at),
        )
        return frame.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(below))

    # A row per range, so at most BUCKETS + 1.
    heads = ranges(keys).groupBy("_range").agg(F.max("_key").alias("_key")).orderBy(F.desc("_range")).collect()
    hosts = [(h["_key"], heads[i - 1]["_range"]) for i, h in enumerate(heads)]
    spark = documents.sparkSession
    guests = spark.createDataFrame(hosts, f"_key {dict(rows.dtypes)['_key']}, _host int") if hosts else None
    if guests is None:
        return rows.select(F.col("_key").alias(key), *columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    guest_keys = F.broadcast(guests.withColumnRenamed("_key", "_head"))
    placed = ranges(rows).join(guest_keys, F.col("_key").eqNullSafe(F.col("_head")), "left")
    both = placed.withColumn(
        "_at",
        F.explode(
            F.when(
                F.col("_host").isNotNull(),
                F.array(
                    F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest")),
                    F.struct(F.col("_host").alias("range"), F.lit(True).alias("guest")),
                ),
            ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))))
        ),
    ).select("_key", *columns, F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.desc_nulls_last("_key"), *columns)
    ahead = F.lead(F.struct(*columns)).over(order)
    return (
        both.withColumn("_next", ahead)
        .where(~F.col("_guest"))
        .select(F.col("_key").alias(key), *columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
    )


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprints of texts, of edited texts, and how alike they are.

    The last third of a text, in code points, gives way to as many (or all) first code points of
    the next document by descending `doc_id`. Null text is empty. Per row: `doc_id`, `n_chars`,
    `edited_sha256`, both fingerprints as text, `near_edited` and `near_next` by `containment`,
    and the same two by `resemblance`.
    """
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Only texts are shuffled: a sketch takes less time to make again than room in a shuffle.
    rows = with_next(texts, ["text"]).withColumn("_n", F.length("text"))
    third = F.floor(F.col("_n") / 3).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.col("_n") - third), F.substr("next_text", F.lit(1), third)
    )
    done = rows.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), "text", "next_text", edited.alias("_edited"),
        sketch(F.col("text")).alias("print"), sketch(F.col("next_text")).alias("next_print"),
    ).withColumn("edited_print", sketch(F.col("_edited")))
    # Of a very short text the sketch may hold nothing to compare; then, and only then, the texts are.
    pair = lambda name, text: F.coalesce(
        comparable(F.col("print"), F.col(name)), comparable_texts(F.col("text"), F.col(text))
    )
    compared = done.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "print", "edited_print",
        pair("edited_print", "_edited").alias("_edit"), pair("next_print", "next_text").alias("_after"),
    )
    return compared.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("print", "").alias("fingerprint"),
        F.array_join("edited_print", "").alias("edited_fingerprint"),
        containment(F.col("_edit")).alias("near_edited"),
        containment(F.col("_after")).alias("near_next"),
        resemblance(F.col("_edit")).alias("resembles_edited"),
        resemblance(F.col("_after")).alias("resembles_next"),
    )
