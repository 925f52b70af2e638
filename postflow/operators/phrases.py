"""Sentiment labels from a lexicon of words and phrases, with negation."""

import functools

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postflow.functions.text import tokens
from postflow.operators.joins import split_join
from postflow.operators.lexicon import BROADCAST_BYTES, HOT_BYTES, HOT_ROWS, hot_texts, label_of, least_posts, lexicon_bytes
from postflow.staging import stage, unused

SCOPE = 3  # words that a negation reaches
HELD_BYTES = 2 * BROADCAST_BYTES  # of a length, by `lexicon_bytes`; packed, its entries take less than that in a broadcast
TERMS = 8  # beginnings that are packed into one row
FILTER_WORDS, FILTER_BITS, PROBES = 16, 8, 3  # longs of a block of the filter, its bits for a beginning, and those a beginning sets
BLOCK_BYTES = 8 * FILTER_WORDS + 64  # of the filter, in a broadcast


def phrase_trie(entries: DataFrame) -> tuple[DataFrame, int]:
    """`(depth, prefix, polarity, posts)` of all beginnings of the `entries` `(phrase, polarity)`, and the greatest depth.

    Phrases are split as texts are. Entries of the same words add up; those without words or with
    polarity 0 in the end count for nothing. A beginning that is no entry has no polarity, null or 0.
    `posts` is how frequent its most frequent entry is, if the entries tell. Entries are shuffled once, with their beginnings.
    """
    posts = F.col("posts").cast("bigint") if "posts" in entries.columns else F.lit(None).cast("bigint")
    words = entries.select(tokens(F.col("phrase")).alias("words"), F.col("polarity").cast("bigint").alias("polarity"), posts.alias("posts"))
    depths = F.sequence(F.lit(1), F.size("words"))
    nodes = words.where((F.size("words") > 0) & (F.col("polarity") != 0)).select("words", "polarity", "posts", F.explode(depths).alias("depth")).select(
        F.array_join(F.slice("words", F.lit(1), F.col("depth")), " ").alias("prefix"), "depth",
        F.when(F.col("depth") == F.size("words"), F.col("polarity")).alias("polarity"), "posts",
    )
    summed = nodes.groupBy("depth", "prefix").agg(
        F.sum("polarity").alias("polarity"), F.max("posts").alias("posts"), F.count_if(F.col("polarity").isNull()).alias("longer")
    ).where("polarity <> 0 or longer > 0")
    trie = stage(summed.select("depth", "prefix", "polarity", "posts"), "trie")
    return trie, trie.agg(F.max("depth")).first()[0] or 0


def matches(texts: DataFrame, trie: DataFrame, longest: int, negators, scope: int, broadcast_bytes: int = HELD_BYTES) -> DataFrame:
    """`(digest, polarity)` that add up to all occurrences of entries in `texts` `(digest, words)`, overlapping ones included.

    Every word begins a walk down the trie. Each step looks up the beginnings of one more word, so
    only words that began an entry so far go on. The polarity is turned around if one of the
    `negators` is among the `scope` words ahead of the occurrence.

    Beginnings of a length that are too large to be broadcast together are looked up in two steps:
    the most frequent in a broadcast, and the others, of all such lengths together, in one shuffle of
    only those walks that a Bloom filter of them lets through. Walks are made twice then, which
    writes less than to keep them.
    """
    # A row per word, with the words ahead of it and whether those before it are negators; built-in functions throughout, as there is one for every word.
    ahead = [f"word_{n}" for n in range(longest)]
    columns = [F.col("words") if n == 0 else F.slice("words", n + 1, F.size("words")) for n in range(longest)]
    before, held = [], texts
    if negators and scope:
        before, held = [f"turn_{n}" for n in range(scope)], texts.withColumn("turns", F.transform("words", lambda w: w.isin(*negators)))
        columns += [F.concat(F.array_repeat(F.lit(False), n + 1), "turns") for n in range(scope)]
    denied = functools.reduce(Column.__or__, [F.coalesce(n, F.lit(False)) for n in before], F.lit(False))
    starts = F.arrays_zip(*[c.alias(n) for c, n in zip(columns, [*ahead, *before])])
    walk = held.select("digest", F.inline(starts)).where(F.col(ahead[0]).isNotNull()).select(
        "digest", *ahead, F.when(denied, -1).otherwise(1).alias("sign"), F.lit(0).cast("bigint").alias("total")
    )
    others, asked = None, []
    for depth in range(1, longest + 1):
        level = trie.where(F.col("depth") == depth).select(F.col("prefix").alias("term"), "polarity", "posts")
        # A walk without a beginning of one word less has none of this length either, nor has one that is at its text's end.
        word = F.col(ahead[depth - 1])
        walk = walk.withColumn("prefix", word if depth == 1 else F.when(F.col("on"), F.concat("prefix", F.lit(" "), word)))
        size = lexicon_bytes(level)
        if size <= broadcast_bytes:
            # At first no word goes on that begins no entry.
            walk = _looked_up(walk, level, "inner" if depth == 1 else "left").withColumn("on", F.col("held")).drop("held")
            continue
        least = least_posts(level, size, broadcast_bytes)
        often = F.coalesce(F.col("posts") >= least, F.lit(False)) if least is not None else F.lit(False)
        walk = walk.withColumn("held", F.lit(False)) if least is None else _looked_up(walk, level.where(often), "left")
        other = stage(level.where(~often).select("term", "polarity"), "trie-level")
        others = other if others is None else others.unionByName(other)
        asks = F.coalesce(~F.col("held") & F.col("may_be") & F.col("prefix").isNotNull(), F.lit(False))
        name = f"asked_{depth}"
        walk = _may_be_among(walk, other, broadcast_bytes).withColumn(name, F.when(asks, F.col("prefix")))
        walk = walk.withColumn("on", F.col("held") | F.col(name).isNotNull()).drop("held", "may_be")
        asked.append(name)
    total = (F.col("total") * F.col("sign")).alias("polarity")
    if others is None:
        return walk.select("digest", total)
    # Beginnings of different lengths differ, so one table and one shuffle have them all. The side that is hashed has a term once.
    each = walk.select("digest", "sign", F.explode(F.array(*asked)).alias("asked")).where(F.col("asked").isNotNull())
    entries = others.where("polarity <> 0").hint("shuffle_hash")
    found = each.join(entries, F.col("asked") == F.col("term")).select("digest", (F.col("polarity") * F.col("sign")).alias("polarity"))
    return walk.select("digest", total).where("polarity <> 0").unionByName(found)


def _looked_up(walk: DataFrame, level: DataFrame, how: str) -> DataFrame:
    """Walks with the polarity of their `prefix` added, and whether it is one of `level`, which is broadcast.

    Some terms with their polarities are one row there, as a row for each would take several times the memory.
    """
    buckets = F.lit(max(1, level.count() // TERMS))
    packed = level.groupBy(F.pmod(F.xxhash64("term"), buckets).alias("bucket")).agg(F.collect_list(F.struct("term", F.coalesce("polarity", F.lit(0)).alias("polarity"))).alias("listed"))
    packed = packed.select("bucket", F.col("listed.term").alias("terms"), F.col("listed.polarity").alias("polarities"))
    found = walk.join(F.broadcast(packed), F.pmod(F.xxhash64("prefix"), buckets) == F.col("bucket"), how)
    found = found.withColumn("at", F.coalesce(F.array_position("terms", F.col("prefix")), F.lit(0)).cast("int"))
    added = F.col("total") + F.when(F.col("at") > 0, F.get("polarities", F.col("at") - 1)).otherwise(0)
    found = found.withColumns({"total": added, "held": F.col("at") > 0}).drop("bucket", "terms", "polarities", "at")
    return found.where("held") if how == "inner" else found


def _may_be_among(walk: DataFrame, terms: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Walks with `may_be`: false only if `prefix` is none of the `terms`, whose Bloom filter is broadcast.

    The filter has `FILTER_BITS` a term, or fewer if it would be too large, and then lets more through.
    """
    block_bits = 64 * FILTER_WORDS
    most = min(broadcast_bytes, BROADCAST_BYTES) // BLOCK_BYTES
    blocks = F.lit(max(1, min(-(-terms.count() * FILTER_BITS // block_bits), most)))
    block = lambda c: F.pmod(F.xxhash64(c), blocks)
    bits = lambda c: F.xxhash64(F.lit(1), c)
    bit = [F.shiftright("bits", 10 * n).bitwiseAND(F.lit(block_bits - 1)).cast("int") for n in range(PROBES)]
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)))
    own = lambda n: F.when(F.shiftright("bit", 6) == n, mask).otherwise(F.lit(0).cast("bigint"))
    # Hashes are dealt by block before they are combined, as every task would make all of the filter.
    hashed = terms.select(block("term").alias("block"), bits("term").alias("bits")).repartition("block")
    table = hashed.select("block", F.explode(F.array(*bit)).alias("bit")).groupBy("block").agg(
        F.array(*[F.bit_or(own(n)) for n in range(FILTER_WORDS)]).alias("words")
    )
    found = walk.withColumn("bits", bits("prefix")).join(F.broadcast(table), block("prefix") == F.col("block"), "left")
    is_set = [
        F.call_function("shiftright", F.get("words", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1 for b in bit
    ]
    all_set = functools.reduce(Column.__and__, is_set)
    return found.withColumn("may_be", F.coalesce(all_set, F.lit(False))).drop("block", "bits", "words")


def text_digests(posts: DataFrame) -> tuple[Column, DataFrame]:
    """What tells texts apart, null for none, and `(digest, _copies)` of all texts: 64 bits of hash, or MD5 if two texts have the same."""
    text = F.col("cleaned_text")
    for digest in (_short_digest(text), F.md5(text)):
        digest, other = F.when(text.isNotNull(), digest), F.xxhash64(F.lit(1), text)
        counted = posts.groupBy(digest.alias("digest")).agg(
            F.count("*").alias("_copies"), F.min(other).alias("least"), F.max(other).alias("most")
        )
        # Left out only here: a condition on the text would be tested ahead, where the text is made anew.
        copies = stage(counted, "text-copies").where(F.col("digest").isNotNull())
        if copies.where("least <> most").isEmpty():
            break
    return digest, copies.select("digest", "_copies")


def _short_digest(text: Column) -> Column:
    return F.xxhash64(text)


def label_by_phrases(
    posts: DataFrame, entries: DataFrame, negators=(), scope: int = SCOPE, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES,
    broadcast_bytes: int = HELD_BYTES,
) -> DataFrame:
    """`posts` with `sentiment_result`, an array of one label, from a lexicon `(phrase, polarity)` of any size.

    The label is the sign of the summed polarities of all occurrences of entries in `cleaned_text`,
    overlapping ones included; null text has a null array. Sums are per distinct text, so ids may
    repeat or be null, and texts of very many posts are split on the way back.
    """
    trie, longest = phrase_trie(entries)
    own, held, known = unused(posts, "digest", "polarity", "known")
    digest, copies = text_digests(posts)
    texts = posts.select(digest.alias("digest"), tokens(F.col("cleaned_text")).alias("words"))
    if longest:
        found = matches(texts, trie, longest, [n.lower() for n in negators], scope, broadcast_bytes)
        summed = copies.join(found.groupBy("digest").agg(F.sum("polarity").alias("sum")), "digest", "left")
    else:
        summed = copies.withColumn("sum", F.lit(0).cast("bigint"))
    # Copies of a text add up to a multiple of its own sum.
    total = (F.coalesce("sum", F.lit(0)) / F.col("_copies")).cast("bigint")
    sums = stage(summed.select(F.col("digest").alias(own), total.alias(held), "_copies"), "text-polarity")
    hot = hot_texts(sums, own, at_least=hot_rows)
    # Null texts are dealt by the rest of their rows, so that no scan of all posts is for them alone; what they may find there counts for nothing.
    dealt = [F.col(f"`{f.name}`") for f in posts.schema if f.name != "cleaned_text" and isinstance(f.dataType, (T.NumericType, T.StringType, T.DatetimeType))]
    key = F.coalesce(digest, F.xxhash64(F.lit(0), *dealt).cast(sums.schema[own].dataType))
    keyed = posts.withColumns({own: key, known: F.col("cleaned_text").isNotNull()})
    scored = split_join(keyed, sums.drop("_copies"), own, hot, "left", hot_bytes)
    return scored.withColumn("sentiment_result", F.when(F.col(known), label_of(F.col(held)))).select(*posts.columns, "sentiment_result")


def derive_phrases(labelled: DataFrame, toxic_weight: int = 7, min_posts: int = 3) -> DataFrame:
    """`(phrase, polarity, posts)` of one and two words from posts with `cleaned_text` and a label `toxic`, 0 or 1, as `derive_lexicon` has words."""
    words = labelled.select(F.when(F.col("toxic") == 1, -toxic_weight).otherwise(1).alias("vote"), tokens(F.col("cleaned_text")).alias("words"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i))
    )
    phrases = F.concat(F.col("words"), F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return (
        words.select("vote", F.explode(F.array_distinct(phrases)).alias("phrase"))
        .groupBy("phrase")
        .agg(F.sum("vote").alias("net"), F.count("*").alias("posts"))
        .where((F.col("posts") >= min_posts) & (F.col("net") != 0))
        .select("phrase", F.signum("net").cast("int").alias("polarity"), "posts")
    )
