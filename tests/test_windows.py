"""Tiles and windows over streams, against plain Python, with replays, restarts and late posts."""

import collections
import datetime as dt
import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from postflow.operators import reports
from postflow.streaming.tiles import Pyramid, run_tiles
from postflow.streaming.windows import read_late, read_windows, run_windows, sessions, sliding, split_late, stream_in_time

UTC = dt.timezone.utc
NOW = {"availableNow": True}
START = dt.datetime(2024, 1, 1, tzinfo=UTC)


# --- tiles --------------------------------------------------------------------------------


def placed(n, seed, box=(-90, -180, 90, 180)):
    rng = random.Random(seed)
    s, w, north, e = box
    for _ in range(n):
        nowhere = rng.random() < 0.1
        yield (None, None, 1) if nowhere else (rng.uniform(s, north), rng.uniform(w, e), rng.choice([1, 0, -1, None]))


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "lat double, lon double, sentiment_score int")


def tiles(rows, degrees=10.0, levels=3):
    held = collections.defaultdict(list)
    for lat, lon, score in rows:
        if lat is not None:
            for level in range(levels):
                side = degrees * 2 ** level
                held[level, math.floor(lat / side), math.floor(lon / side)].append(score)
    known = {k: [v for v in scores if v is not None] for k, scores in held.items()}
    return {k: (len(held[k]), round(sum(v) / len(v), 9) if v else None) for k, v in known.items()}


def stored(spark, pyramid):
    return {
        (r.level, r.cell_lat, r.cell_lon): (r.posts, None if r.mean_score is None else round(r.mean_score, 9))
        for r in pyramid.read(spark).collect()
    }


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_batches_add_up_and_rewrite_only_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "tiles")
    pyramid = Pyramid(path)
    assert stored(spark, pyramid) == {}
    batches = [list(placed(300, 1)), list(placed(80, 2, (1, 1, 39, 39))), list(placed(50, 3, (-39, -39, 39, 39))), []]
    all_ = []
    for number, rows in enumerate(batches):
        before, seen = files(path), pyramid.versions(spark)
        touched = pyramid.add(frame(spark, rows), number)
        all_ += rows
        assert stored(spark, pyramid) == tiles(all_)
        changed = {r for r, v in pyramid.versions(spark).items() if v != seen.get(r)}
        assert changed == set(touched) == {f"{a}_{b}" for level, a, b in tiles(rows) if level == 2}
        fresh = {f for f in files(path) if f not in before}
        assert all(f"version={number}/" in f for f in fresh)
        assert all(files(path)[f] == t for f, t in before.items() if os.path.exists(f))
    finest = {(r.cell_lat, r.cell_lon): r.posts for r in reports.grid_counts(frame(spark, all_), 10.0).collect()}
    assert finest == {k[1:]: v[0] for k, v in tiles(all_).items() if k[0] == 0}
    assert {k: v for k, v in stored(spark, pyramid).items() if k[0] == 1} == {
        (r.level, r.cell_lat, r.cell_lon): (r.posts, None if r.mean_score is None else round(r.mean_score, 9))
        for r in pyramid.read(spark, 1).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    pyramid = Pyramid(str(tmp_path / "tiles"))
    rows = [list(placed(60, s, (0, 0, 35, 35))) for s in range(3)]
    for number, some in enumerate(rows):
        for _ in range(2):
            pyramid.add(frame(spark, some), number)
    assert stored(spark, pyramid) == tiles(sum(rows, []))


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    path = tmp_path / "tiles"
    pyramid = Pyramid(str(path))
    rows = [list(placed(60, s)) for s in (5, 6)]
    for number, some in enumerate(rows):
        pyramid.add(frame(spark, some), number)
    (path / "version=1" / "_SUCCESS").unlink()
    assert stored(spark, pyramid) == tiles(rows[0])
    pyramid.add(frame(spark, rows[1]), 1)
    assert stored(spark, pyramid) == tiles(rows[0] + rows[1])


def test_old_versions_go(spark, tmp_path):
    pyramid = Pyramid(str(tmp_path / "tiles"))
    some = list(placed(20, 1, (1, 1, 9, 9)))
    for number in range(5):
        pyramid.add(frame(spark, some), number)
    # The one that is read, and the one that a replay of the last batch adds to.
    assert len(files(str(tmp_path / "tiles"))) == 2 and stored(spark, pyramid) == tiles(some * 5)


def test_tiles_of_a_stream(spark, tmp_path):
    rows = list(placed(400, 8))
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lat double, lon double, sentiment_score int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    pyramid = Pyramid(str(tmp_path / "tiles"), degrees=5.0, levels=4)
    run_tiles(stream, pyramid, str(tmp_path / "checkpoint"), NOW).awaitTermination()
    assert stored(spark, pyramid) == tiles(rows, 5.0, 4)


# --- windows ------------------------------------------------------------------------------

SCHEMA = "created_at timestamp, hashtags array<string>, sentiment_score int"


def posts(n, seed, hours=48):
    rng = random.Random(seed)
    for _ in range(n):
        at = None if rng.random() < 0.03 else START + dt.timedelta(seconds=rng.randrange(hours * 3600))
        yield at, rng.choice([None, [], ["Rain"], ["rain", "RAIN", "wind"], ["wind", None]]), rng.choice([1, 0, -1, None])


def put(spark, rows, folder):
    """One more file of the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def close(spark, folder):
    put(spark, [(START + dt.timedelta(days=400), None, None)], folder)


def plain_sessions(rows, gap):
    by_tag = collections.defaultdict(list)
    for at, tags, score in rows:
        for tag in {t.lower() for t in tags or [] if t} if at else ():
            by_tag[tag].append((at, score))
    out = []
    for tag, seen in by_tag.items():
        run = []
        for at, score in sorted(seen, key=lambda r: r[0]):
            if run and at - run[-1][0] > gap:
                out.append(row(tag, run[0][0], run[-1][0] + gap, run))
                run = []
            run.append((at, score))
        out.append(row(tag, run[0][0], run[-1][0] + gap, run))
    return sorted(out, key=repr)


def row(tag, start, end, run):
    known = [s for _, s in run if s is not None]
    return tag, int(start.timestamp()), int(end.timestamp()), len(run), round(sum(known) / len(known), 9) if known else None


def plain_sliding(rows, width, slide):
    held = collections.defaultdict(list)
    for at, tags, score in rows:
        for tag in {t.lower() for t in tags or [] if t} if at else ():
            first = int(at.timestamp()) // slide * slide
            for begin in range(first, first - width, -slide):
                if begin + width > int(at.timestamp()):
                    held[tag, begin].append((at, score))
    utc = lambda s: dt.datetime.fromtimestamp(s, UTC)
    return sorted((row(tag, utc(b), utc(b + width), run) for (tag, b), run in held.items()), key=repr)


def closed(spark, path):
    rows = read_windows(spark, path).select(
        "hashtag", F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"), "posts", F.round("mean_score", 9).alias("m")).collect()
    return sorted(map(tuple, rows), key=repr)


def windows(spark, tmp_path, source, window, lateness="100 days"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    run_windows(stream, window, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lateness, NOW).awaitTermination()
    return closed(spark, str(tmp_path / "out"))


@pytest.mark.parametrize("kind", ["sessions", "sliding"])
def test_windows_over_shuffled_files_with_a_restart(spark, conf, tmp_path, kind):
    conf("spark.sql.shuffle.partitions", "2")
    rows, source = list(posts(240, 1)), str(tmp_path / "in")
    window = sessions("20 minutes") if kind == "sessions" else sliding("2 hours", "1 hour")
    for part in range(2):
        put(spark, rows[part::4], source)
    assert windows(spark, tmp_path, source, window) == []  # all of it is open
    for part in range(2, 4):
        put(spark, rows[part::4], source)
    close(spark, source)
    windows(spark, tmp_path, source, window)  # goes on from the checkpoint
    want = plain_sessions(rows, dt.timedelta(minutes=20)) if kind == "sessions" else plain_sliding(rows, 7200, 3600)
    assert closed(spark, str(tmp_path / "out")) == want


def test_a_gap_as_long_as_allowed_still_joins(spark, conf, tmp_path):
    conf("spark.sql.shuffle.partitions", "2")
    rows = [(START + dt.timedelta(minutes=m), ["a"], 1) for m in (0, 20, 41)]
    put(spark, rows, str(tmp_path / "in"))
    close(spark, str(tmp_path / "in"))
    assert windows(spark, tmp_path, str(tmp_path / "in"), sessions("20 minutes")) == plain_sessions(rows, dt.timedelta(minutes=20))


def test_late_posts_have_a_table_of_their_own(spark, conf, tmp_path):
    conf("spark.sql.shuffle.partitions", "2")
    source, good, late = (str(tmp_path / n) for n in ("raw", "good", "late"))
    at = lambda hours: START + dt.timedelta(hours=hours)
    first = [(at(10), ["a"], 1), (at(2), ["a"], 0), (None, ["a"], 1)]
    second = [(at(8.5), ["a"], 1), (at(7), ["a"], -1), (at(20), ["b"], 1)]  # 7 is over two hours behind 10
    third = [(at(18), ["b"], 1), (at(9), ["b"], 1), (at(2000), None, None)]
    for rows in (first, second, third):
        put(spark, rows, source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        split_late(stream, good, late, str(tmp_path / "split"), "2 hours", NOW).awaitTermination()
    got = read_late(spark, late, SCHEMA).select("created_at").collect()
    assert sorted((r.created_at.astimezone(UTC) if r.created_at else None for r in got), key=str) == sorted([None, at(7), at(9)], key=str)
    in_time = [r for r in first + second + third if r[0] not in (None, at(7), at(9))]
    stream = stream_in_time(spark, good, SCHEMA, maxFilesPerTrigger=1)
    run_windows(stream, sessions("20 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "2 hours", NOW).awaitTermination()
    assert closed(spark, str(tmp_path / "out")) == plain_sessions(in_time, dt.timedelta(minutes=20))
    with pytest.raises(ValueError):
        split_late(stream, good, late, str(tmp_path / "x"), "soon")
