"""A positional index, for phrases and for words near each other."""

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postflow.functions.text import normal_terms, word_places
from postflow.operators.joins import split_repeated
from postflow.operators.text_index import BUCKETS, by_range, term_bucket

SPAN = 256  # words of a post in a block; also the longest phrase and the widest search


def position_postings(df: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """Rows `(term, id, block, gaps, first)`: where a term stands in a post, counted in words from 0.

    A block covers `span` words of the post, so a row has at most that many positions. They are
    sorted and delta-coded: the first gap counts from the block's beginning, each other one from
    the position before. `first` marks a term's first block in the post. Blocks are made in the
    post's row, without a shuffle. Rows of one id are one post, and only where an id repeats their
    blocks meet in a shuffle; a null text has no rows.
    """
    placed = lambda rows: rows.select("id", F.inline(word_places(F.col(text), span)))
    columns = ["term", "id", "block", "gaps", "first"]
    once, repeated = split_repeated(df.select("id", text), "id")
    if repeated is None:
        return placed(once).select(columns)
    words = placed(repeated).select("term", "id", "block", F.explode(places(span)).alias("pos"))
    held = words.groupBy("term", "id", "block").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    before = F.concat(F.array(F.col("block") * span), F.slice("places", F.lit(1), F.size("places") - 1))
    first = F.col("block") == F.min("block").over(Window.partitionBy("term", "id"))
    gaps = F.zip_with("places", before, lambda p, b: p - b).alias("gaps")
    return placed(once).select(columns).unionByName(held.select("term", "id", "block", gaps, first.alias("first")))


def places(span: int) -> Column:
    """The positions of a row, decoded from its `gaps`."""
    start = F.struct((F.col("block") * span).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda so_far, gap: F.struct(
        (so_far["at"] + gap).alias("at"), F.concat(so_far["places"], F.array(so_far["at"] + gap)).alias("places")
    )
    return F.aggregate("gaps", start, step, lambda done: done["places"])


def write_positions(posting_rows: DataFrame, path: str, buckets: int = BUCKETS, span: int = SPAN, tasks: int | None = None) -> None:
    """Store position postings in folders by term bucket, and the number of posts of each term likewise.

    Range-partitioned on `(bucket, term, id, block)`, so a term that fills a third of the index is
    written by a third of the tasks, `tasks` or Spark's own number of them. What reading needs is
    written last: an index without it is unfinished. `span` is the one the rows were made with.
    """
    spark = posting_rows.sparkSession
    order = ["bucket", "term", "id", "block"]
    (
        by_range(posting_rows.withColumn("bucket", term_bucket(F.col("term"), buckets)), order, tasks)
        .write.partitionBy("bucket")
        .mode("overwrite")
        .parquet(f"{path}/positions")
    )
    stored = spark.read.schema(_POSITIONS).parquet(f"{path}/positions")
    # Each post counts by its first block of a term.
    counts = stored.groupBy("bucket", "term").agg(F.count_if("first").alias("df"))
    counts.repartitionByRange("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/counts")
    about = spark.createDataFrame([(buckets, span)], "buckets int, span int")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


_POSITIONS = "term string, id bigint, block int, gaps array<int>, first boolean, bucket int"


@dataclass(frozen=True)
class PositionIndex:
    """A stored positional index; a search reads the folders of its terms and no text."""

    spark: SparkSession
    path: str
    buckets: int
    span: int

    def phrase_search(self, phrase: str) -> DataFrame:
        """`(id, hits)`: posts with the words of `phrase` one behind the other, and how often.

        Only posts with the phrase's rarest word go through the merge. Each word's positions, less
        its place in the phrase, are where the phrase may begin; what all words have in common is
        where it does.
        """
        words = phrase_words(phrase)
        if len(words) > self.span:
            raise ValueError(f"a phrase has at most {self.span} words, got {len(words)}")
        begins, block = F.col("begins"), F.col("block")
        nth = F.explode(_where(words, lambda term: F.array(*[F.lit(i) for i, w in enumerate(words) if w == term])))
        rows = self._postings(words).select("id", "block", places(self.span).alias("places"), nth.alias("nth"))
        begun = rows.select("id", "block", "nth", F.transform("places", lambda p: p - F.col("nth")).alias("begins"))
        edge = block * self.span
        # A beginning may lie in the block before its word.
        parts = F.array(
            F.struct(block.alias("block"), F.filter(begins, lambda b: b >= edge).alias("begins")),
            F.struct((block - 1).alias("block"), F.filter(begins, lambda b: (b < edge) & (b >= 0)).alias("begins")),
        )
        cut = begun.select("id", "nth", F.inline(F.filter(parts, lambda p: F.size(p["begins"]) > 0)))
        of = [F.flatten(F.collect_list(F.when(F.col("nth") == i, F.col("begins")))).alias(f"w{i}") for i in range(len(words))]
        common = functools.reduce(F.array_intersect, [F.col(f"w{i}") for i in range(len(words))])
        met = cut.groupBy("id", "block").agg(*of).select("id", F.size(F.array_distinct(common)).alias("hits"))
        return met.where("hits > 0").groupBy("id").agg(F.sum("hits").alias("hits"))

    def near_search(self, terms, within: int) -> DataFrame:
        """`(id, words)`: posts with some run of at most `within` words that holds all terms, and the least such run.

        The terms' positions are merged in order; behind each one stands where every other term was
        last, and the run reaches from the earliest of these.
        """
        wanted = normal_terms(terms)
        if not len(wanted) <= within <= self.span:
            raise ValueError(f"within must be from the number of terms to {self.span}, got {within}")
        block = F.col("block")
        which = _where(wanted, lambda term: F.lit(wanted.index(term)))
        entries = F.transform(places(self.span), lambda p: F.struct(p.alias("pos"), F.col("which").alias("which")))
        rows = self._postings(wanted).withColumn("which", which).select("id", "block", entries.alias("entries"))
        edge = (block + 1) * self.span
        # A run may begin in the block before the one that it ends in.
        parts = F.array(
            F.struct(block.alias("block"), F.col("entries")),
            F.struct((block + 1).alias("block"), F.filter("entries", lambda e: e["pos"] > edge - within).alias("entries")),
        )
        cut = rows.select("id", F.inline(F.filter(parts, lambda p: F.size(p["entries"]) > 0)))
        merged = cut.groupBy("id", "block").agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"))
        never = F.lit(-(1 << 30))
        start = F.struct(F.array_repeat(never, len(wanted)).alias("last"), F.lit(1 << 30).alias("least"))

        def step(so_far: Column, entry: Column) -> Column:
            last = F.transform(so_far["last"], lambda at, i: F.when(i == entry["which"], entry["pos"]).otherwise(at))
            # One element binds the array, which is looked at twice.
            return F.transform(F.array(last), lambda held: F.struct(
                held.alias("last"), F.least(so_far["least"], entry["pos"] - F.array_min(held) + 1).alias("least")
            ))[0]

        least = merged.select("id", F.aggregate("entries", start, step, lambda done: done["least"]).alias("words"))
        return least.where(F.col("words") <= within).groupBy("id").agg(F.min("words").alias("words"))

    def counts(self, terms) -> DataFrame:
        return self._rows("counts", "term string, df bigint, bucket int", terms).select("term", "df")

    def _postings(self, words: list[str]) -> DataFrame:
        """The postings of distinct `words` in posts that have the rarest of them."""
        wanted = list(dict.fromkeys(words))
        found = {r["term"]: r["df"] for r in self.counts(wanted).collect()}  # at most one row a word
        rows = self._rows("positions", _POSITIONS, wanted).select("term", "id", "block", "gaps")
        if len(found) < len(wanted):
            return rows.where(F.lit(False))
        if len(wanted) == 1:
            return rows
        rarest = min(wanted, key=lambda w: (found[w], w))
        posts = rows.where(F.col("term") == rarest).select("id").distinct()
        return rows.join(posts, "id", "left_semi")

    def _rows(self, folder: str, schema: str, wanted: list[str]) -> DataFrame:
        folders = [term_bucket(F.lit(t), self.buckets) for t in wanted]
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        return stored.where(F.col("bucket").isin(*folders) & F.col("term").isin(wanted))


def read_positions(spark: SparkSession, path: str) -> PositionIndex:
    """An index as `write_positions` left it."""
    about = spark.read.parquet(f"{path}/about").first()
    return PositionIndex(spark, path, about["buckets"], about["span"])


def phrase_words(phrase: str) -> list[str]:
    """The words of a phrase, lower-cased, repeats included, as `tokens` finds them."""
    words = re.findall(r"[^\W_]+", phrase.lower())
    if not words:
        raise ValueError(f"a phrase needs a word, got {phrase!r}")
    return words


def _where(words: list[str], value) -> Column:
    """By the row's term, `value` of it."""
    out = F
    for term in dict.fromkeys(words):
        out = out.when(F.col("term") == term, value(term))
    return out
