"""The registered queries, over posts derived from the given tables.

`raw_posts` gives every document a time, a place, hashtags and a counter from the event of the
same number, in the schema of a raw post. Each query returns plain columns (numbers, strings,
epoch seconds) so that results compare by value.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflow.functions.envelope import accepted, decode, encode, rejected, restore_time
from postflow.functions.geo import lat_lon
from postflow.functions.score import sentiment_score
from postflow.functions.text import clean_text, tokens
from postflow.functions.times import parse_post_time
from postflow.operators import nearest, reports, search, trends
from postflow.operators.bitmaps import BitmapIndex, read_bitmaps, write_bitmaps
from postflow.operators.block_index import BlockIndex, read_blocks, write_blocks
from postflow.operators.dense_index import dense_index as add_dense_index
from postflow.operators.joins import enrich_join as lookup, replay_join as replay
from postflow.operators.lexicon import BROADCAST_BYTES, ENTRY_BYTES, derive_lexicon, labeller, normal_lexicon, with_polarity
from postflow.operators.model import fit_naive_bayes
from postflow.operators.phrases import derive_phrases, label_by_phrases
from postflow.operators.positions import PositionIndex, position_postings, read_positions, write_positions
from postflow.operators.text_index import TextIndex, doc_counts, index_tasks, postings, ranked_search as rank, read_index, write_index
from postflow.plans.posts import annotation_labels as unpack_annotations, compat_columns as five_columns, enrich, process
from postflow.sources.layout import compact, read_layout, write_layout
from postflow.sources.readers import malformed_lines, read_envelopes, read_posts, stream_posts
from postflow.sources.sinks import envelope_files, read_batches, write_envelopes
from postflow.staging import mark, matching, new_folder, stage
from postflow.streaming.flows import read_histogram, run_histogram, run_ingest, run_process, run_replay
from postflow.streaming.tiles import Pyramid, run_tiles
from postflow.streaming.windows import read_windows, run_windows, sessions, split_late, stream_in_time

ANY_TERMS = ["worthless", "trash", "idiot"]
ALL_TERMS = ["the", "and", "trash"]
RANK_TERMS = ["the", "trash", "stupid", "clown"]
NEGATORS = ["is", "of"]  # the texts are invented, so are their negations
PHRASE = "the and attion"
NEAR_TERMS, WITHIN = ["the", "and", "is"], 6
FROM, TO = "2024-01-01T06:00:00", "2024-01-02T18:30:00"
BOX = (-40.0, -100.0, 45.0, 60.0)
DATELINE_BOX = (-60.0, 150.0, 60.0, -140.0)
TALL_BOX = (-85.0, 175.0, 80.0, -170.0)
NEAREST = 5
CENTER, RADIUS_KM = (10.0, 170.0), 3000.0
CELL = 10.0
SHARE = 0.08
GAP, LATENESS = "30 minutes", "100 days"  # no post is late
TAG = "Tag3"
NOW = {"availableNow": True}


# --- the given tables as posts ------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_posts(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Documents with the event of the same number, in the schema of a raw post; all of them, or
    those in a table of ids, in which case no other text leaves the scan. Without such an event
    the time and the counter are null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if ids is not None:
        docs = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    n = F.col("doc_id")
    lat = ((n * 37) % 180).cast("double") - 89.5
    lon = ((n * 91) % 360).cast("double") - 179.5
    first = F.concat(F.lit("tag"), n % 13)
    second = F.when(n % 3 == 0, F.concat(F.lit("tag"), n % 7))
    tag = lambda t: F.struct(t.alias("text"), F.lit(None).cast("array<bigint>").alias("indices"))
    # Both tables grow with the data, so neither is broadcast.
    return docs.join(events.hint("merge"), F.col("event_id") == n, "left").select(
        n.alias("id"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        _post_text(n).alias("text"),
        F.col("user_id").alias("retweet_count"),
        F.when(
            n % 5 != 0,
            F.struct(F.lit("Point").alias("type"), F.array(lat, lon).alias("coordinates")),
        ).alias("geo"),
        F.struct(
            F.when(n % 3 == 0, F.array(tag(first), tag(second)))
            .otherwise(F.array(tag(first)))
            .alias("hashtags")
        ).alias("entities"),
    )


def _post_text(n):
    return F.concat(F.col("text"), F.lit(" http://t.co/"), n, F.lit(" @u"), n % 97, F.lit(" #tag"), n % 13)


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(id, cleaned_text)` of all posts, as `enriched_posts` has them. Events only count here where
    several have one number, so their numbers are shuffled and not the texts."""
    n = F.col("doc_id")
    posts = table(spark, sf_dir, "documents").select(n.alias("id"), clean_text(_post_text(n)).alias("cleaned_text"))
    counted = table(spark, sf_dir, "events").where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("times"))
    repeated = stage(counted.where("times > 1"), "repeated-events")
    if repeated.isEmpty():
        return posts
    found = posts.join(repeated, F.col("event_id") == F.col("id"), "left")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))).select("id", "cleaned_text")


def enriched_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(raw_posts(spark, sf_dir))


def placed(df: DataFrame) -> DataFrame:
    lat, lon = lat_lon(F.col("coordinates"))
    return df.withColumns({"lat": lat, "lon": lon})


def post_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned posts that have a label."""
    labels = post_labels(spark, sf_dir)
    posts = raw_posts(spark, sf_dir, labels).select("id", clean_text(F.col("text")).alias("cleaned_text"))
    return posts.join(labels, "id")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_lexicon(labelled_posts(spark, sf_dir))


def stored_labeller(spark: SparkSession, sf_dir: str, route: str = "join"):
    return labeller(lexicon(spark, sf_dir), route)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(enriched_posts(spark, sf_dir), stored_labeller(spark, sf_dir))


_stored: dict[tuple, str] = {}


def _built_once(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """The path of a stored table; `write(path)` runs once per application and state of its inputs."""
    inputs = tuple(mark(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "events", "labels"))
    key = (spark.sparkContext.applicationId, sf_dir, label, inputs)
    if key not in _stored:
        path = new_folder(spark, label)
        write(path)
        _stored[key] = path
    return _stored[key]


def processed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed posts in the query-ready layout."""
    write = lambda path: write_layout(processed(spark, sf_dir), path)
    return read_layout(spark, _built_once(spark, sf_dir, "processed", write))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored inverted index."""

    def write(path: str) -> None:
        documents = table(spark, sf_dir, "documents")
        write_index(inverted_index(spark, sf_dir), documents.count(), path, tasks=index_tasks(documents))

    return read_index(spark, _built_once(spark, sf_dir, "text-index", write))


def position_index(spark: SparkSession, sf_dir: str) -> PositionIndex:
    """The stored positional index."""

    def write(path: str) -> None:
        tasks = index_tasks(table(spark, sf_dir, "documents"))
        write_positions(position_postings(enriched_posts(spark, sf_dir), "cleaned_text"), path, tasks=tasks)

    return read_positions(spark, _built_once(spark, sf_dir, "positions", write))


def block_index(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The stored postings in blocks."""

    def write(path: str) -> None:
        documents = table(spark, sf_dir, "documents")
        write_blocks(inverted_index(spark, sf_dir), documents.count(), path, tasks=index_tasks(documents))

    return read_blocks(spark, _built_once(spark, sf_dir, "blocks", write))


def curve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed posts in the layout along the curve."""
    write = lambda path: write_layout(processed_table(spark, sf_dir), path, cluster="curve", stored=True)
    return read_layout(spark, _built_once(spark, sf_dir, "curve", write))


def bitmap_index(spark: SparkSession, sf_dir: str) -> BitmapIndex:
    """The processed posts in order of their bitmaps' numbers."""
    columns = ["id", "created_at", "lat", "lon", "hashtags", "text", "sentiment_score"]
    write = lambda path: write_bitmaps(processed_table(spark, sf_dir).select(*columns), path, stored=True)
    return read_bitmaps(spark, _built_once(spark, sf_dir, "bitmaps", write))


# What searches and reports read, built once; the bench times the building by itself.
BUILDS = {
    "processed table": processed_table, "text index": text_index, "positional index": position_index,
    "block index": block_index, "curve table": curve_table, "bitmap index": bitmap_index,
}


def epoch(name: str = "created_at"):
    return F.unix_seconds(F.col(name)).alias(f"{name.removesuffix('_at')}_epoch")


def joined(name: str = "hashtags"):
    return F.array_join(name, ",").alias(name)


def flat(df: DataFrame) -> DataFrame:
    """Processed posts as plain columns."""
    return df.select("id", epoch(), "lat", "lon", joined(), "text", "sentiment_score")


def rounded_mean():
    return F.round("mean_score", 6).alias("mean_score")


# --- projections and scalar functions -----------------------------------------------------


def post_hashtags(spark, sf_dir):
    return enriched_posts(spark, sf_dir).select("id", F.size("hashtags").alias("n_tags"), joined())


def post_coordinates(spark, sf_dir):
    return placed(enriched_posts(spark, sf_dir)).select("id", "lat", "lon")


def cleaned(spark, sf_dir):
    return raw_posts(spark, sf_dir).select("id", clean_text(F.col("text")).alias("cleaned_text"))


def parse_time(spark, sf_dir):
    parsed = parse_post_time(F.col("created_at")).alias("created_at")
    return raw_posts(spark, sf_dir).select("id", parsed).select("id", epoch())


def sentiment_score_query(spark, sf_dir):
    """Score lists with one label per word, written as one bracketed string. The words meet the lexicon in a join."""
    stored = stage(normal_lexicon(lexicon(spark, sf_dir)), "lexicon")
    posts = enriched_posts(spark, sf_dir).select("id", tokens(F.col("cleaned_text")).alias("words"))
    words = posts.select("id", F.col("words").isNotNull().alias("known"), F.posexplode_outer("words").alias("pos", "term"))
    labelled = with_polarity(words, stored, salt="id")
    label = F.when(F.col("polarity") > 0, "pos").when(F.col("polarity") < 0, "neg").otherwise("neutral")
    # A list has as many labels as its post has words.
    lists = labelled.groupBy("id", "known").agg(F.collect_list(label).alias("labels"))
    bracketed = F.array(F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("]")))
    return lists.select("id", F.when(F.col("known"), sentiment_score(bracketed)).cast("bigint").alias("score"))


def annotation_labels(spark, sf_dir):
    """Annotations, one per hashtag, unpacked into labels and scored."""
    results = F.transform("hashtags", lambda t: F.struct(F.when(t == "tag3", "neg").otherwise("pos").alias("result"), t.alias("begin")))
    annotated = enriched_posts(spark, sf_dir).select("id", results.alias("sentiment"))
    labelled = unpack_annotations(annotated)
    return labelled.select("id", F.array_join("sentiment_result", ",").alias("labels"), sentiment_score(F.col("sentiment_result")).alias("score"))


# --- index and joins ----------------------------------------------------------------------


def indexed_posts(spark, sf_dir, *columns):
    posts = raw_posts(spark, sf_dir)
    return add_dense_index(posts.select(*columns) if columns else posts, ["retweet_count", "id"])


def dense_index(spark, sf_dir):
    return indexed_posts(spark, sf_dir, "id", "retweet_count")


def replay_join(spark, sf_dir):
    """Every event number is a tick; those past the last post pick none."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_id").alias("value"))
    posts = indexed_posts(spark, sf_dir)
    return (
        replay(ticks, posts)
        .select("index", "id", parse_post_time(F.col("created_at")).alias("created_at"),
                clean_text(F.col("text")).alias("cleaned_text"))
        .select("index", "id", epoch(), "cleaned_text")
    )


def enrich_join(spark, sf_dir):
    posts = raw_posts(spark, sf_dir)
    hashtags = posts.select("id", F.col("entities.hashtags.text").alias("hashtags"))
    facts = posts.select("id", clean_text(F.col("text")).alias("cleaned_text"))
    return lookup(facts, hashtags, "id").select("id", joined(), "cleaned_text")


# --- envelope -----------------------------------------------------------------------------


def envelope_roundtrip(spark, sf_dir):
    values = encode(enriched_posts(spark, sf_dir)).select(F.col("value").cast("binary").alias("value"))
    posts = placed(restore_time(accepted(decode(values, keep_json=True))))
    return posts.select("id", epoch(), "lat", "lon", joined(), "cleaned_text")


def envelope_rejects(spark, sf_dir):
    """Envelopes mixed with plain texts: the texts, and only they, are rejected."""
    values = encode(enriched_posts(spark, sf_dir)).unionByName(
        table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    )
    return rejected(decode(values, keep_json=True))


# --- sentiment ----------------------------------------------------------------------------


def _labels(labelled):
    return labelled.select("id", F.array_join("sentiment_result", ",").alias("label"))


def lexicon_terms(spark, sf_dir):
    return lexicon(spark, sf_dir).select("term", "polarity")


def sentiment_lexicon(spark, sf_dir):
    posts = enriched_posts(spark, sf_dir).select("id", "cleaned_text")
    return _labels(stored_labeller(spark, sf_dir)(posts))


def sentiment_phrases(spark, sf_dir):
    """Labels from words and pairs of words, turned around behind a negator."""
    posts, labels = post_texts(spark, sf_dir), post_labels(spark, sf_dir)
    # Labels are small beside the texts, which would else be shuffled to meet them.
    few = labels.count() * ENTRY_BYTES <= BROADCAST_BYTES
    entries = derive_phrases(posts.join(F.broadcast(labels) if few else labels, "id"))
    return _labels(label_by_phrases(posts, entries, NEGATORS))


def sentiment_lexicon_joined(spark, sf_dir):
    """As for a lexicon that is too large to be broadcast."""
    posts = enriched_posts(spark, sf_dir).select("id", "cleaned_text")
    return _labels(labeller(lexicon(spark, sf_dir), broadcast_bytes=0)(posts))


def learned(posts):
    """The rows a learned model is fitted on: three quarters, by a fixed hash of the id."""
    return posts.where(F.pmod(F.col("id") * 7919, F.lit(4)) != 0)


def sentiment_model(spark, sf_dir):
    terms, bias = fit_naive_bayes(learned(labelled_posts(spark, sf_dir)))
    labelled = labeller(terms, bias=bias)(enriched_posts(spark, sf_dir).select("id", "cleaned_text"))
    return labelled.select(
        "id",
        F.array_join("sentiment_result", ",").alias("label"),
        sentiment_score(F.col("sentiment_result")).alias("sentiment_score"),
    )


def processed_posts(spark, sf_dir):
    return flat(processed(spark, sf_dir))


def compat_columns(spark, sf_dir):
    lat, lon = lat_lon(F.col("coordinates"))
    return five_columns(processed(spark, sf_dir)).select(
        "created_at", lat.alias("lat"), lon.alias("lon"), joined(), "text", "sentiment_score"
    )


# --- search, on the processed table or the stored index -----------------------------------


def text_search_any(spark, sf_dir):
    return search.text_search(processed_table(spark, sf_dir), ANY_TERMS, "any").select("id")


def text_search_all(spark, sf_dir):
    return search.text_search(processed_table(spark, sf_dir), ALL_TERMS, "all").select("id")


def inverted_index(spark, sf_dir):
    return postings(enriched_posts(spark, sf_dir), "cleaned_text")


def term_counts(spark, sf_dir):
    return doc_counts(inverted_index(spark, sf_dir))


def ranked_search(spark, sf_dir):
    return rank(processed_table(spark, sf_dir), RANK_TERMS, 50)


def index_search(spark, sf_dir):
    return text_index(spark, sf_dir).posts_with(ALL_TERMS, "all")


def index_ranked_search(spark, sf_dir):
    return text_index(spark, sf_dir).ranked_search(RANK_TERMS, 50)


def phrase_search(spark, sf_dir):
    return position_index(spark, sf_dir).phrase_search(PHRASE)


def near_search(spark, sf_dir):
    return position_index(spark, sf_dir).near_search(NEAR_TERMS, WITHIN)


def block_ranked_search(spark, sf_dir):
    return block_index(spark, sf_dir).ranked_search(RANK_TERMS, 50).best


def time_range(spark, sf_dir):
    return search.time_range(processed_table(spark, sf_dir), FROM, TO).select("id", epoch())


def bbox_search(spark, sf_dir):
    return search.box_search(processed_table(spark, sf_dir), *BOX).select("id", "lat", "lon")


def bbox_search_dateline(spark, sf_dir):
    return search.box_search(processed_table(spark, sf_dir), *DATELINE_BOX).select("id", "lat", "lon")


def box_search_curve(spark, sf_dir):
    return search.curve_box_search(curve_table(spark, sf_dir), *TALL_BOX).select("id", "lat", "lon")


def nearest_posts(spark, sf_dir):
    """Each hundredth post against all."""
    posts = processed_table(spark, sf_dir).select("id", "lat", "lon")
    return nearest.nearest_posts(posts, posts.where(F.col("id") % 100 == 1), NEAREST)


def radius_search(spark, sf_dir):
    found = search.radius_search(processed_table(spark, sf_dir), *CENTER, RADIUS_KM)
    return found.select("id", F.round("distance_km", 3).alias("distance_km"))


def hashtag_search(spark, sf_dir):
    return search.hashtag_search(processed_table(spark, sf_dir), TAG).select("id", joined())


def combined_search(spark, sf_dir):
    found = search.combined_search(
        processed_table(spark, sf_dir), ALL_TERMS[:2], "all", (FROM, TO), BOX
    )
    return flat(found)


def combined_search_indexed(spark, sf_dir):
    found = search.combined_search(
        processed_table(spark, sf_dir), ALL_TERMS[:2], "all", (FROM, TO), BOX, index=text_index(spark, sf_dir)
    )
    return flat(found)


def combined_search_bitmap(spark, sf_dir):
    return flat(bitmap_index(spark, sf_dir).combined_search(ALL_TERMS[:2], "all", (FROM, TO), BOX))


# --- reports, on the processed table ------------------------------------------------------


def time_histogram(spark, sf_dir):
    buckets = reports.time_histogram(processed_table(spark, sf_dir), "6 hours")
    return buckets.select(F.unix_seconds("bucket_start").alias("bucket_epoch"), "posts", rounded_mean())


def grid_counts(spark, sf_dir):
    cells = reports.grid_counts(processed_table(spark, sf_dir), CELL)
    return cells.select("cell_lat", "cell_lon", "posts", rounded_mean())


def hashtag_counts(spark, sf_dir):
    return reports.hashtag_counts(processed_table(spark, sf_dir), 10)


def _with_rounded_mean(df):
    return df.withColumn("mean_score", rounded_mean())


def sentiment_by_hashtag(spark, sf_dir):
    return _with_rounded_mean(reports.sentiment_by_hashtag(processed_table(spark, sf_dir)))


def sentiment_by_day(spark, sf_dir):
    days = reports.sentiment_by_day(processed_table(spark, sf_dir))
    return _with_rounded_mean(days.withColumn("day", F.col("day").cast("string")))


def sentiment_by_cell(spark, sf_dir):
    return _with_rounded_mean(reports.sentiment_by_cell(processed_table(spark, sf_dir), CELL))


# --- streams ------------------------------------------------------------------------------


def _finish(query):
    query.awaitTermination()


STREAM_FILES = 6  # each stream's input, of which a micro-batch takes
BATCH_FILES = 2
STREAM_BYTES = 16 << 20  # of stored texts that make a file of a larger input
BATCHES = 3  # of an input that tasks wrote, however many files they made
BATCH_BYTES = 2 << 30  # but no micro-batch takes more


def batch_files(spark, path) -> int:
    """How many files of a folder a micro-batch takes, so that neither more tasks nor more posts make more micro-batches up to `BATCH_BYTES` each."""
    files, (size, *_) = len(matching(spark, f"{path}/part-*")), mark(spark, path)
    return max(BATCH_FILES, min(-(-files // BATCHES), files * BATCH_BYTES // max(size, 1)))


def json_posts(spark, sf_dir, files: int | None = None) -> str:
    """All posts as JSON lines in a folder of their own."""
    path = new_folder(spark, "json-posts")
    posts = raw_posts(spark, sf_dir)
    (posts.repartition(files) if files else posts).write.json(path)
    return path


def json_scan(spark, sf_dir):
    posts = enrich(read_posts(spark, json_posts(spark, sf_dir)))
    return placed(posts).select("id", epoch(), "lat", "lon", joined(), "cleaned_text")


def json_rejects(spark, sf_dir):
    """A broken line for every document, among the posts: the broken ones come back as they were."""
    broken = F.concat(F.lit('{"id":'), F.col("doc_id"), F.lit(',"text":"cut'))
    posts = raw_posts(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return malformed_lines(posts.unionByName(table(spark, sf_dir, "documents").select(broken.alias("value"))))


def ingested(spark, raw) -> str:
    """Envelopes of a stream of raw posts, as text files."""
    folder = new_folder(spark, "topic")
    _finish(run_ingest(raw, "text", f"{folder}/checkpoint", NOW, path=f"{folder}/values"))
    return f"{folder}/values"


def processed_batches(spark, sf_dir) -> str:
    """Posts through both streams, in several micro-batches each, into stored ones."""
    files = max(STREAM_FILES, mark(spark, f"{sf_dir}/documents.parquet")[0] // STREAM_BYTES)
    raw = json_posts(spark, sf_dir, files)
    values = ingested(spark, stream_posts(spark, raw, maxFilesPerTrigger=batch_files(spark, raw)))
    folder = new_folder(spark, "batches")
    _finish(run_process(
        read_envelopes(spark, "text", path=values, maxFilesPerTrigger=batch_files(spark, values)), stored_labeller(spark, sf_dir),
        f"{folder}/posts", f"{folder}/rejects", f"{folder}/checkpoint", NOW,
    ))
    return f"{folder}/posts"


def stream_processed_posts(spark, sf_dir):
    return flat(read_batches(spark, processed_batches(spark, sf_dir)))


def layout_search(spark, sf_dir):
    """Streams, then compaction of the first micro-batch and of the others, then a pruned search."""
    path, batches = new_folder(spark, "layout"), processed_batches(spark, sf_dir)
    compact(spark, batches, path, 0, 0)
    compact(spark, batches, path, 1)
    return flat(search.combined_search(read_layout(spark, path), between=(FROM, TO), box=DATELINE_BOX))


def stream_replay(spark, sf_dir):
    """Replay through a stream: event numbers arrive as files of ticks."""
    ticks = new_folder(spark, "ticks")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("value"))
    events.repartition(STREAM_FILES).write.parquet(ticks)
    stream = spark.readStream.schema("value bigint").option("maxFilesPerTrigger", BATCH_FILES).parquet(ticks)
    folder = new_folder(spark, "topic")
    values = f"{folder}/values"
    indexed = add_dense_index(raw_posts(spark, sf_dir), ["retweet_count", "id"], path=f"{folder}/indexed")
    _finish(run_replay(stream, indexed, envelope_files(values), f"{folder}/checkpoint", NOW))
    decoded = restore_time(decode(read_envelopes(spark, "text", stream=False, path=values)))
    return decoded.select("id", epoch(), "cleaned_text")


def topic_start(spark, sf_dir):
    """A topic of files read from its beginning and from the time at which half of it was there."""
    folder = new_folder(spark, "topic-start")
    values = encode(enriched_posts(spark, sf_dir).select("id", "created_at"))
    odd = F.get_json_object("value", "$.id").cast("bigint") % 2 == 1
    values.where(~odd).write.text(f"{folder}/values")
    half = spark.read.text(f"{folder}/values").agg(F.max("_metadata.file_modification_time")).first()[0]
    values.where(odd).write.mode("append").text(f"{folder}/values")
    found = None
    for start, position in (("earliest", "earliest"), ("half", half.astimezone(dt.timezone.utc))):
        files = batch_files(spark, f"{folder}/values")
        read = read_envelopes(spark, "text", path=f"{folder}/values", start=position, maxFilesPerTrigger=files)
        _finish(write_envelopes(read, "text", f"{folder}/checkpoint-{start}", NOW, path=f"{folder}/{start}"))
        posts = restore_time(decode(read_envelopes(spark, "text", stream=False, path=f"{folder}/{start}")))
        posts = posts.select(F.lit(start).alias("start"), "id", epoch())
        found = posts if found is None else found.unionByName(posts)
    return found


def stream_time_histogram(spark, sf_dir):
    """Posts arrive in files of any order, a few per micro-batch; none is late."""
    source = new_folder(spark, "histogram-input")
    posts = processed_table(spark, sf_dir).select("created_at", "sentiment_score")
    posts.repartition(STREAM_FILES).write.parquet(source)
    schema = "created_at timestamp, sentiment_score int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(source)
    folder = new_folder(spark, "histogram")
    _finish(run_histogram(stream, f"{folder}/buckets", f"{folder}/checkpoint", "6 hours", NOW))
    buckets = read_histogram(spark, f"{folder}/buckets")
    return buckets.select(F.unix_seconds("bucket_start").alias("bucket_epoch"), "posts", rounded_mean())


def _post_stream(spark, sf_dir, label: str, *columns: str):
    """Columns of the processed posts as a stream of files in any order, some per micro-batch; its folder and schema, too."""
    source = new_folder(spark, label)
    posts = processed_table(spark, sf_dir).select(*columns)
    posts.repartition(STREAM_FILES).write.parquet(source)
    return spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(source), source, posts


def tile_counts(spark, sf_dir):
    """Tiles of three levels, kept up to date by micro-batches."""
    stream, _, _ = _post_stream(spark, sf_dir, "tiles-input", "lat", "lon", "sentiment_score")
    folder = new_folder(spark, "tiles")
    pyramid = Pyramid(f"{folder}/tiles", CELL)
    _finish(run_tiles(stream, pyramid, f"{folder}/checkpoint", NOW))
    return _with_rounded_mean(pyramid.read(spark))


def trending_hashtags(spark, sf_dir):
    """Summaries of micro-batches name the candidates, the stored posts their counts."""
    stream, _, posts = _post_stream(spark, sf_dir, "trends-input", "created_at", "hashtags")
    folder = new_folder(spark, "trends")
    _finish(trends.run_summaries(stream, f"{folder}/summaries", f"{folder}/checkpoint", "6 hours", trigger=NOW))
    found = trends.trending(trends.read_summaries(spark, f"{folder}/summaries"), posts, "6 hours", SHARE)
    return found.select(F.unix_seconds("bucket_start").alias("bucket_epoch"), "hashtag", "posts", "uses")


def stream_sessions(spark, sf_dir):
    """Sessions of every hashtag, closed by a row without hashtags that comes last, long after all posts."""
    stream, source, posts = _post_stream(spark, sf_dir, "sessions-input", "created_at", "hashtags", "sentiment_score")
    after = (F.max("created_at") + F.expr("interval 300 days")).alias("created_at")
    none = [F.lit(None).cast(t).alias(c) for c, t in posts.dtypes if c != "created_at"]
    posts.agg(after).select("created_at", *none).coalesce(1).write.mode("append").parquet(source)
    folder = new_folder(spark, "sessions")
    _finish(split_late(stream, f"{folder}/posts", f"{folder}/late", f"{folder}/split", LATENESS, NOW))
    in_time = stream_in_time(spark, f"{folder}/posts", posts.schema, maxFilesPerTrigger=2 * BATCH_FILES)
    _finish(run_windows(in_time, sessions(GAP), f"{folder}/sessions", f"{folder}/checkpoint", LATENESS, NOW))
    return read_windows(spark, f"{folder}/sessions").select(
        "hashtag", F.unix_seconds("start").alias("start_epoch"), F.unix_seconds("end").alias("end_epoch"), "posts", rounded_mean()
    )


QUERIES = {
    "post_hashtags": post_hashtags,
    "post_coordinates": post_coordinates,
    "clean_text": cleaned,
    "parse_time": parse_time,
    "json_scan": json_scan,
    "json_rejects": json_rejects,
    "dense_index": dense_index,
    "replay_join": replay_join,
    "enrich_join": enrich_join,
    "envelope_roundtrip": envelope_roundtrip,
    "envelope_rejects": envelope_rejects,
    "lexicon_terms": lexicon_terms,
    "sentiment_lexicon": sentiment_lexicon,
    "sentiment_lexicon_joined": sentiment_lexicon_joined,
    "sentiment_phrases": sentiment_phrases,
    "annotation_labels": annotation_labels,
    "sentiment_score": sentiment_score_query,
    "sentiment_model": sentiment_model,
    "processed_posts": processed_posts,
    "compat_columns": compat_columns,
    "text_search_any": text_search_any,
    "text_search_all": text_search_all,
    "inverted_index": inverted_index,
    "term_counts": term_counts,
    "ranked_search": ranked_search,
    "index_search": index_search,
    "index_ranked_search": index_ranked_search,
    "phrase_search": phrase_search,
    "near_search": near_search,
    "block_ranked_search": block_ranked_search,
    "time_range": time_range,
    "time_histogram": time_histogram,
    "bbox_search": bbox_search,
    "bbox_search_dateline": bbox_search_dateline,
    "box_search_curve": box_search_curve,
    "radius_search": radius_search,
    "nearest_posts": nearest_posts,
    "grid_counts": grid_counts,
    "hashtag_counts": hashtag_counts,
    "hashtag_search": hashtag_search,
    "sentiment_by_hashtag": sentiment_by_hashtag,
    "sentiment_by_day": sentiment_by_day,
    "sentiment_by_cell": sentiment_by_cell,
    "combined_search": combined_search,
    "combined_search_indexed": combined_search_indexed,
    "combined_search_bitmap": combined_search_bitmap,
    "layout_search": layout_search,
    "stream_replay": stream_replay,
    "stream_processed_posts": stream_processed_posts,
    "stream_time_histogram": stream_time_histogram,
    "topic_start": topic_start,
    "tile_counts": tile_counts,
    "trending_hashtags": trending_hashtags,
    "stream_sessions": stream_sessions,
}
