"""Streams give what batch gives, in any number of micro-batches, and replays are safe."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.functions.envelope import encode
from postflow.operators.dense_index import dense_index
from postflow.operators.joins import replay_join
from postflow.operators.lexicon import label_posts
from postflow.operators.reports import time_histogram
from postflow.plans import catalog
from postflow.plans.posts import enrich, process
from postflow.schema import PROCESSED
from postflow.sources.readers import (
    malformed_lines, read_envelopes, read_malformed, read_posts, stream_lines, stream_posts, stream_ticks,
)
from postflow.sources.sinks import committed, envelope_files, read_batches, write_batch, write_batch_to_store, write_envelopes
from postflow.staging import stage
from postflow.streaming.flows import read_histogram, run_histogram, run_ingest, run_process, run_replay
from test_posts import post, write_json

NOW = {"availableNow": True}
UTC = dt.timezone.utc


def label(df):
    return label_posts(df, df.sparkSession.createDataFrame([("good", 1), ("bad", -1)], "term string, polarity int"))


def rows(df):
    return sorted(map(repr, df.collect()))


def source(folder, n=30):
    for part in range(3):
        write_json(folder, [
            post(i, f"{'good' if i % 2 else 'bad'} post #x{i} http://y/{i}", tags=(f"t{i % 4}",),
                 place=None if i % 5 == 0 else (i, -i), at=f"Thu Sep 12 07:{i:02}:00 +0000 2013")
            for i in range(part, n, 3)])
    return str(folder)


def ingest_and_process(spark, tmp_path, path, **options):
    out = str(tmp_path)
    run_ingest(stream_posts(spark, path, **options), "text", f"{out}/c1", NOW, path=f"{out}/topic").awaitTermination()
    run_process(read_envelopes(spark, "text", path=f"{out}/topic"), label, f"{out}/posts", f"{out}/rejects",
                f"{out}/c2", NOW).awaitTermination()
    return f"{out}/posts"


BROKEN = ['{"id": 7, "text": "cut', "not json", "[1, 2]", '{"id": "seven"}', "17"]


def test_stream_equals_batch(spark, tmp_path):
    path = source(tmp_path / "in")
    (tmp_path / "in" / "broken.json").write_text("\n".join([BROKEN[0], "", *BROKEN[1:], "   "]) + "\n")
    want = process(enrich(read_posts(spark, path)), label)
    assert want.count() == 30
    got = read_batches(spark, ingest_and_process(spark, tmp_path, path, maxFilesPerTrigger=1)).drop("batch_id", "query")
    assert rows(got) == rows(want)
    lines = malformed_lines(stream_lines(spark, path, maxFilesPerTrigger=1))
    out = str(tmp_path)
    lines.writeStream.format("parquet").option("path", f"{out}/bad").option("checkpointLocation", f"{out}/c3").trigger(**NOW).start().awaitTermination()
    assert rows(spark.read.parquet(f"{out}/bad")) == rows(read_malformed(spark, path))
    assert sorted(r.line for r in read_malformed(spark, path).collect()) == sorted(BROKEN)


def test_another_checkpoint_overwrites_nothing(spark, tmp_path):
    out = str(tmp_path)
    for n in (1, 2):
        topic = tmp_path / f"topic{n}"
        topic.mkdir()
        (topic / "a.txt").write_text('{"id":%d,"cleaned_text":"good"}\n' % n)
        run_process(read_envelopes(spark, "text", path=str(topic)), label, f"{out}/p", f"{out}/r", f"{out}/c{n}", NOW).awaitTermination()
    assert sorted(r.id for r in read_batches(spark, f"{out}/p").collect()) == [1, 2]


def test_topics_start_at_the_earliest_offset(monkeypatch):
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

        def load(self):
            return self

        def select(self, _):
            return self

    class Session:
        readStream, read = Reader(), Reader()

    monkeypatch.setattr("postflow.sources.readers.F.col", lambda name: name)
    assert read_envelopes(Session, "kafka", subscribe="t").seen == {"format": "kafka", "startingOffsets": "earliest", "subscribe": "t"}
    assert read_envelopes(Session, "kafka", startingOffsets="latest").seen["startingOffsets"] == "latest"
    assert "startingOffsets" not in read_envelopes(Session, "text", stream=False, path="p").seen
    assert read_envelopes(Session, "kafka", start="latest").seen["startingOffsets"] == "latest"
    assert read_envelopes(Session, "kafka", start="2024-01-01T00:00:00").seen["startingTimestamp"] == "1704067200000"
    with pytest.raises(ValueError):
        read_envelopes(Session, "text", start="latest")


def test_a_replay_to_a_topic_arrives_twice_and_can_be_told(spark, tmp_path):
    from postflow.sources.sinks import envelope_topic, without_replays

    path = str(tmp_path / "topic")
    write = envelope_topic("json", path=path)
    batches = [["a", "b"], ["a", "c", "c"]]
    for number, values in [(0, batches[0]), (1, batches[1]), (1, batches[1])]:  # the second is replayed
        write(spark.createDataFrame([(v,) for v in values], "value string"), number)
    records = spark.read.schema("key string, value string").json(path)
    assert records.count() == 8
    assert sorted(r.value for r in without_replays(records).collect()) == ["a", "a", "b", "c"]


def test_files_are_read_from_a_time_on(spark, tmp_path):
    import os

    folder = tmp_path / "topic"
    folder.mkdir()
    for hour, name in ((1, "old"), (3, "new")):
        (folder / f"{name}.txt").write_text(f"{name}\n")
        at = dt.datetime(2024, 1, 1, hour, tzinfo=dt.timezone.utc).timestamp()
        os.utime(folder / f"{name}.txt", (at, at))
    read = lambda **how: sorted(r.value for r in read_envelopes(spark, "text", stream=False, path=str(folder), **how).collect())
    assert read() == ["new", "old"] and read(start="2024-01-01T02:00:00") == ["new"] and read(start="2024-01-01T03:00:00") == []
    values = read_envelopes(spark, "text", path=str(folder), start="2024-01-01T02:00:00")
    for _ in range(2):  # a restart reads nothing twice
        write_envelopes(values, "text", str(tmp_path / "checkpoint"), {"availableNow": True}, path=str(tmp_path / "out")).awaitTermination()
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["new"]


def test_new_files_and_restarts_add_only_what_is_new(spark, tmp_path):
    path = source(tmp_path / "in", 12)
    ingest_and_process(spark, tmp_path, path)
    posts = ingest_and_process(spark, tmp_path, path)  # nothing new
    assert read_batches(spark, posts).count() == 12
    write_json(tmp_path / "in", [post(100)])
    assert read_batches(spark, ingest_and_process(spark, tmp_path, path)).count() == 13


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    path = source(tmp_path / "in", 12)
    posts = ingest_and_process(spark, tmp_path, path)
    commits = tmp_path / "c2" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()  # as if the writer died before it committed
    (commits / f".{last}.crc").unlink(missing_ok=True)
    ingest_and_process(spark, tmp_path, path)
    assert read_batches(spark, posts).count() == 12


def test_rejects_are_kept_apart(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    (topic / "a.txt").write_text('{"id":1,"cleaned_text":"good"}\n{bad\n{}\n')
    out = str(tmp_path)
    run_process(read_envelopes(spark, "text", path=str(topic)), label, f"{out}/p", f"{out}/r", f"{out}/c", NOW).awaitTermination()
    assert [r.id for r in read_batches(spark, f"{out}/p").collect()] == [1]
    assert sorted(r.json for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/r").collect()) == ["{bad", "{}"]


def test_a_connector_can_replace_the_writer(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    (topic / "a.txt").write_text('{"id":1,"cleaned_text":"good"}\n')
    out, stored = str(tmp_path), []
    run_process(read_envelopes(spark, "text", path=str(topic)), label, f"{out}/p", f"{out}/r", f"{out}/c", NOW,
                store=lambda df, batch_id: stored.extend(df.collect())).awaitTermination()
    assert [r.sentiment_score for r in stored] == [1]
    write_batch_to_store(spark.createDataFrame(stored, PROCESSED), "json", path=f"{out}/store")
    assert spark.read.schema(PROCESSED).json(f"{out}/store").collect() == stored


def test_replay_stream_equals_batch(spark, tmp_path):
    raw = read_posts(spark, source(tmp_path / "in"))
    indexed = dense_index(raw, ["retweet_count", "id"])
    ticks = str(tmp_path / "ticks")
    spark.range(0, 50).select(F.col("id").alias("value")).write.parquet(ticks)
    stream = spark.readStream.schema("value bigint").parquet(ticks)
    out = str(tmp_path)
    run_ingest(replay_join(stream, indexed), "text", f"{out}/c", NOW, path=f"{out}/topic").awaitTermination()
    got = read_envelopes(spark, "text", stream=False, path=f"{out}/topic")
    assert got.count() == 30 and got.distinct().count() == 30


def test_replay_by_slices_equals_the_stream_join(spark, tmp_path):
    raw = read_posts(spark, source(tmp_path / "in"))
    indexed = stage(dense_index(raw, ["retweet_count", "id"]), "indexed")
    ticks = tmp_path / "ticks"
    for part in range(5):  # the last ticks are past the last post
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("value")).coalesce(1).write.mode("append").parquet(str(ticks))
    stream = spark.readStream.schema("value bigint").option("maxFilesPerTrigger", 1).parquet(str(ticks))
    out, sizes = str(tmp_path), []
    files = envelope_files(f"{out}/topic")

    def write(values, batch_id):
        sizes.append(values.count())
        files(values, batch_id)

    run_replay(stream, indexed, write, f"{out}/c", NOW).awaitTermination()
    assert sorted(sizes) == [0, 0, 10, 10, 10]
    got = read_envelopes(spark, "text", stream=False, path=f"{out}/topic")
    assert rows(got) == rows(encode(enrich(raw)))
    slice_plan = plan_of(indexed.where(F.col("index").between(3, 5)))
    assert "PushedFilters: [IsNotNull(index), GreaterThanOrEqual(index,3), LessThanOrEqual(index,5)]" in slice_plan


def test_tick_source_schema(spark):
    ticks = stream_ticks(spark, format="rate-micro-batch", rowsPerBatch=5)
    assert [f.simpleString() for f in ticks.schema] == ["timestamp:timestamp", "value:bigint"]
    assert stream_ticks(spark).isStreaming


def scored(spark, rows):
    return spark.createDataFrame(rows, "created_at timestamp, sentiment_score int")


def test_histogram_stream(spark, tmp_path):
    """Posts in files of no order, one per micro-batch, over several runs: the same as in batch."""
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    posts = [(start + dt.timedelta(minutes=20 * (i * 37 % 60)), [1, 0, -1, None][i % 4]) for i in range(60)] + [(None, 1)]
    source, out = str(tmp_path / "in"), str(tmp_path)
    batch = lambda n: time_histogram(scored(spark, posts[:n]), "2 hours").select("bucket_start", "posts", "mean_score")
    for part in range(0, 60, 20):
        scored(spark, posts[part:part + 20]).repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema("created_at timestamp, sentiment_score int").option("maxFilesPerTrigger", 1).parquet(source)
        run_histogram(stream, f"{out}/buckets", f"{out}/c", "2 hours", NOW).awaitTermination()
        assert rows(read_histogram(spark, f"{out}/buckets")) == rows(batch(part + 20))
    assert len(list((tmp_path / "buckets").glob("query=*/batch_id=*"))) > 3
    assert read_histogram(spark, f"{out}/none").count() == 0


def test_write_batch_of_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    empty = process(enrich(spark.createDataFrame([post(1)], read_posts(spark, source(tmp_path / "in")).schema).where("false")), label)
    write_batch(empty, path, 0)
    assert read_batches(spark, path).count() == 0


def test_more_files_do_not_make_more_micro_batches(spark, conf, tmp_path):
    """Tasks wrote 24 files of envelopes, of which a micro-batch takes a third; a large one is cut by its bytes."""
    path = str(tmp_path / "values")
    spark.range(0, 2400, 1, 24).select(F.concat(F.lit("envelope"), "id")).write.text(path)
    assert catalog.batch_files(spark, path) == 8
    conf("spark.sql.files.maxPartitionBytes", "8k")  # so that several tasks read a file of posts
    conf("spark.sql.files.openCostInBytes", "1k")
    assert len(committed(spark, catalog.processed_batches(spark, "/root/testdata/sf0.001"))) == 3


def test_a_micro_batch_is_cut_by_its_bytes(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "values")
    spark.range(0, 2400, 1, 24).select(F.concat(F.lit("envelope"), "id")).write.text(path)
    monkeypatch.setattr(catalog, "BATCH_BYTES", 5_000)
    size = sum(f.stat().st_size for f in (tmp_path / "values").glob("part-*"))
    files = catalog.batch_files(spark, path)
    assert 2 <= files < 8 and files * size / 24 <= 5_000
