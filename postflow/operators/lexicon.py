"""Sentiment labels from a table of terms with polarities."""

import collections
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postflow.functions.text import tokens
from postflow.operators.joins import HOT_BYTES, HOT_ROWS, split_join
from postflow.staging import discard, new_folder, stage, unused

BROADCAST_BYTES = 64 << 20  # up to here a lexicon is broadcast, beyond it its most frequent terms are
ENTRY_BYTES = 48  # what a broadcast entry takes besides its text
TERM_SALTS = 64
ROUTES = ("join", "inline")
INLINE_TERMS = 20_000


def derive_lexicon(labelled: DataFrame, toxic_weight: int = 7, min_posts: int = 3) -> DataFrame:
    """`(term, polarity, posts)` from posts with `cleaned_text` and a label `toxic`, 0 or 1.

    A term's polarity is the sign of its non-toxic posts minus `toxic_weight` times its toxic
    ones; terms in fewer than `min_posts` posts, or with polarity 0, are left out. `posts` is the
    number of posts with the term.
    """
    vote = F.when(F.col("toxic") == 1, -toxic_weight).otherwise(1)
    return (
        labelled.select(
            vote.alias("vote"), F.explode(F.array_distinct(tokens(F.col("cleaned_text")))).alias("term")
        )
        .groupBy("term")
        .agg(F.sum("vote").alias("net"), F.count("*").alias("posts"))
        .where((F.col("posts") >= min_posts) & (F.col("net") != 0))
        .select("term", F.signum("net").cast("int").alias("polarity"), "posts")
    )


def normal_lexicon(lexicon: DataFrame) -> DataFrame:
    """`(term, polarity)` with every term once: repeated terms add up, as whole numbers, and 0 is left out. `posts` stays, if it is there."""
    counts = [F.sum("posts").cast("bigint").alias("posts")] if "posts" in lexicon.columns else []
    return (
        lexicon.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("polarity").cast("bigint").alias("polarity"), *counts)
        .where(F.col("polarity") != 0)
    )


class Labels:
    """Adds `sentiment_result`, an array of one label, to posts; made by `labeller`.

    Labelling by join writes the polarity of each text to a folder. Once the labelled posts are
    stored, `release` deletes what was written for them.
    """

    def __init__(self, label: Callable[..., DataFrame]):
        self._label, self._folders = label, []

    def __call__(self, posts: DataFrame) -> DataFrame:
        return self._label(posts, self._folders)

    def release(self, spark: SparkSession) -> None:
        for folder in self._folders:
            discard(spark, folder)
        self._folders.clear()


def labeller(lexicon: DataFrame, route: str = "join", bias: int = 0, **limits) -> Labels:
    """A function that adds `sentiment_result`, an array of one label, to posts.

    The label is the sign of `bias` plus the summed polarities of the distinct terms of
    `cleaned_text`: pos, neg, or neutral; null text has a null array. The lexicon is normalised
    and written once, so both routes give the same labels. `route` is the caller's choice:
    `join` takes a lexicon of any size, broadcast or shuffled by its measured size (`limits` are
    those of `label_by_join`), best with a column `posts` of how frequent a term is; `inline` puts it into the plan, needs no join or shuffle, and
    refuses more than `INLINE_TERMS` terms.
    """
    if route not in ROUTES:
        raise ValueError(f"route must be one of {ROUTES}, got {route!r}")
    stored = stage(normal_lexicon(lexicon), "normal-lexicon")
    if route == "join":
        size = lexicon_bytes(stored)
        least = least_posts(stored, size, limits.get("broadcast_bytes", BROADCAST_BYTES))
        return Labels(lambda posts, folders: label_by_join(posts, stored, bias, **{"size": size, "least": least, "folders": folders, **limits}))
    polarity = inline_polarity(stored, stored.count())
    return Labels(lambda posts, folders: _label_by_row(posts, polarity, bias))


def label_posts(posts: DataFrame, lexicon: DataFrame, route: str = "join", bias: int = 0) -> DataFrame:
    return labeller(lexicon, route, bias)(posts)


def inline_polarity(lexicon: DataFrame, terms: int) -> Callable[[Column], Column]:
    """A lookup of a term's polarity, 0 for unknown ones, that needs no join.

    For each polarity, 1 and -1 as a rule, the terms become a constant array of hash buckets, of
    about one term each: a long IN list or a map constant would be slow to plan or to search. All
    of it passes through the driver, so more than `INLINE_TERMS` terms are refused.
    """
    if terms > INLINE_TERMS:
        raise ValueError(f"a lexicon of {terms} terms is too large to be inlined, the limit is {INLINE_TERMS}; join it")
    buckets = max(1, terms)

    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    tables = collections.defaultdict(lambda: [[] for _ in range(buckets)])
    for row in lexicon.select(bucket(F.col("term")).alias("bucket"), "term", "polarity").collect():
        tables[row.polarity][row.bucket].append(row.term)
    # Spark folds the parsed text into one constant.
    constants = {
        value: F.from_json(F.lit(json.dumps(table)), "array<array<string>>")
        for value, table in tables.items()
    }

    def polarity(term: Column) -> Column:
        at, found = bucket(term), F.lit(0).cast("bigint")
        for value, table in constants.items():
            found = F.when(F.array_contains(F.get(table, at), term), F.lit(value).cast("bigint")).otherwise(found)
        return found

    return polarity


def _label_by_row(posts: DataFrame, polarity: Callable[[Column], Column], bias: int) -> DataFrame:
    """No join and no shuffle, on a batch or a stream."""
    terms, held = unused(posts, "terms", "polarity")
    total = F.aggregate(terms, F.lit(bias).cast("bigint"), lambda total, term: total + polarity(term))
    # A column of its own: the label looks at the total several times.
    return (
        posts.withColumn(terms, F.array_distinct(tokens(F.col("cleaned_text"))))
        .withColumn(held, total)
        .withColumn("sentiment_result", label_of(F.col(held)))
        .drop(terms, held)
    )


def label_by_join(
    posts: DataFrame, lexicon: DataFrame, bias: int = 0, broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES, size: int | None = None, folders: list | None = None,
    least: int | None = None,
) -> DataFrame:
    """Label with a normal lexicon of any size.

    Terms are exploded and joined, and polarities summed per distinct text: the label depends
    on the text alone, so ids may repeat or be null. Each distinct text counts once.

    The sums come back to the posts through a written table, whose counts of copies tell which
    texts are hot. Its folder is added to `folders`; `size` is that of the lexicon, if known.

    Of a lexicon that is too large to be broadcast, the terms of at least `least` posts are, and
    only what they do not cover is shuffled: the rest of the words, which are few.
    """
    digest = F.md5("cleaned_text")
    # The digest is computed ahead of the explode, which would otherwise copy and hash the text
    # for every term.
    texts = (
        posts.where(F.col("cleaned_text").isNotNull())
        .select(digest.alias("_digest"), F.array_distinct(tokens(F.col("cleaned_text"))).alias("_terms"))
    )
    occurrences = texts.select("_digest", F.posexplode_outer("_terms").alias("_pos", "term"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    sums_of = lambda *by: [F.coalesce(F.sum("polarity"), F.lit(0)).alias("_sum"), F.count_if(first).alias("_copies"), *by]
    if least is None:
        joined = with_polarity(occurrences, lexicon, broadcast_bytes, size, salt="_digest")
        summed = joined.groupBy("_digest").agg(*sums_of())
    else:
        often = F.coalesce(F.col("posts") >= least, F.lit(False))
        frequent, other = (lexicon.where(c).select("term", "polarity") for c in (often, ~often))
        joined = occurrences.join(F.broadcast(frequent), "term", "left")
        # One row per text and word that is still unknown, and one per text for all others, combined before the shuffle.
        unknown = F.when(F.col("polarity").isNull(), F.col("term")).alias("term")
        partial = joined.groupBy("_digest", unknown).agg(*sums_of(F.count("*").alias("_n")))
        ahead = new_folder(posts.sparkSession, "text-words")
        partial.write.parquet(ahead)
        partial = posts.sparkSession.read.schema(partial.schema).parquet(ahead)
        found = partial.where(F.col("term").isNotNull()).select("_digest", "term", "_n").join(other.hint("merge"), "term")
        rest = found.select("_digest", (F.col("polarity") * F.col("_n")).alias("_sum"), F.lit(0).cast("bigint").alias("_copies"))
        summed = partial.select("_digest", "_sum", "_copies").unionByName(rest).groupBy("_digest").agg(
            F.sum("_sum").alias("_sum"), F.sum("_copies").alias("_copies")
        )
    # Copies of a text add up to a multiple of its own sum.
    per_text = (F.col("_sum") / F.col("_copies")).cast("bigint") + F.lit(bias)
    own, held = unused(posts, "digest", "polarity")
    folder = new_folder(posts.sparkSession, "text-polarity")
    written = summed.select(F.col("_digest").alias(own), per_text.alias(held), "_copies")
    written.write.parquet(folder)
    if least is not None:
        discard(posts.sparkSession, ahead)
    if folders is not None:
        folders.append(folder)
    sums = posts.sparkSession.read.schema(written.schema).parquet(folder)
    scored = split_join(
        posts.withColumn(own, digest), sums.drop("_copies"), own, hot_texts(sums, own, at_least=hot_rows), "left", hot_bytes
    )
    return scored.withColumn("sentiment_result", label_of(F.col(held))).drop(own, held).select(
        *posts.columns, "sentiment_result"
    )


def lexicon_bytes(lexicon: DataFrame) -> int:
    """What a broadcast of the lexicon takes, about."""
    return lexicon.agg(F.sum(F.octet_length("term") + ENTRY_BYTES)).first()[0] or 0


def least_posts(lexicon: DataFrame, size: int, broadcast_bytes: int) -> int | None:
    """The least number of posts of those terms of a large lexicon that fit into a broadcast together; None if none do, or all.

    Terms are taken by steps of a quarter of a power of two, of which there are few.
    """
    if size <= broadcast_bytes or "posts" not in lexicon.columns:
        return None
    step = F.floor(F.log2("posts") * 4)
    steps = lexicon.where("posts > 0").groupBy(step.alias("step")).agg(
        F.min("posts").alias("least"), F.sum(F.octet_length("term") + ENTRY_BYTES).alias("bytes")
    )
    least, held = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):
        held += row["bytes"]
        if held > broadcast_bytes:
            break
        least = row["least"]
    return least


def with_polarity(
    occurrences: DataFrame, lexicon: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, size: int | None = None, salt: str = "_digest"
) -> DataFrame:
    """Left join on `term`: broadcast where the lexicon's measured size allows, else shuffled.

    In the shuffle every term is salted by the column `salt` and the task it comes from, as common
    words fill a large share of the rows; the lexicon is repeated once per salt. The planner, which
    knows the size of the files but not of the repeats, is kept from broadcasting these.
    """
    lexicon = lexicon.select("term", "polarity")
    if (lexicon_bytes(lexicon) if size is None else size) <= broadcast_bytes:
        return occurrences.join(F.broadcast(lexicon), "term", "left")
    number = F.pmod(F.xxhash64(salt, F.spark_partition_id()), F.lit(TERM_SALTS)).cast("int")
    salted = occurrences.withColumn("_salt", number)
    salts = F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
    return salted.join(lexicon.withColumn("_salt", salts).hint("merge"), ["term", "_salt"], "left")


def hot_texts(sums: DataFrame, digest: str, share: float = 0.001, at_least: int = HOT_ROWS) -> list[str]:
    """Digests of texts that make up at least `share` of the rows; at most `1 / share`. One job if no text has `at_least` rows."""
    about = sums.agg(F.sum("_copies").alias("rows"), F.max("_copies").alias("most")).first()
    least = max(at_least, int((about["rows"] or 0) * share))
    if (about["most"] or 0) < least:
        return []
    return [r[0] for r in sums.where(F.col("_copies") >= least).select(digest).collect()]


def label_of(total: Column) -> Column:
    return F.when(
        total.isNotNull(),
        F.array(F.when(total > 0, "pos").when(total < 0, "neg").otherwise("neutral")),
    )
