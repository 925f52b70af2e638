"""Raw posts, envelopes and processed posts."""

import datetime as dt
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postflow.functions.envelope import accepted, decode, encode, rejected, restore_time
from postflow.plans.posts import annotation_labels, compat_columns, enrich, enrich_by_lookup, process
from postflow.schema import ENVELOPE, POST, PROCESSED
from postflow.sources.readers import read_malformed, read_posts

UTC = dt.timezone.utc


def post(id, text="hi", tags=("x",), at="Thu Sep 12 07:15:00 +0000 2013", place=(40.0, -105.0), **more):
    return {
        "id": id, "created_at": at, "text": text, "retweet_count": 1,
        "geo": None if place is None else {"type": "Point", "coordinates": list(place)},
        "entities": None if tags is None else {"hashtags": [{"text": t, "indices": [0, 1]} for t in tags]},
        **more,
    }


def write_json(folder, posts):
    folder.mkdir(parents=True, exist_ok=True)
    name = folder / f"part-{len(list(folder.iterdir()))}.json"
    name.write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in posts))
    return str(folder)


def test_scan_and_enrich(spark, tmp_path):
    path = write_json(tmp_path / "in", [
        post(1, "a #b http://c", tags=("storm", "Hail"), user={"ignored": 1}),
        post(2, tags=(), place=None), post(3, tags=None, at="bad"), "{broken", "[]",
    ])
    raw = read_posts(spark, path)
    assert raw.schema == POST
    rows = {r.id: r for r in enrich(raw).collect()}
    assert rows[1].hashtags == ["storm", "Hail"] and rows[1].cleaned_text == "a  "
    assert rows[1].coordinates == [40.0, -105.0] and rows[1].created_at is not None
    assert rows[2].hashtags == [] and rows[2].coordinates is None
    assert rows[3].hashtags is None and rows[3].created_at is None
    assert raw.count() == 3
    assert sorted(r.line for r in read_malformed(spark, path).collect()) == ["[]", "{broken"]


def test_lookup_gives_the_same_as_the_projection(spark):
    raw = spark.createDataFrame([post(i, tags=(f"t{i}",)) for i in range(20)], POST)
    side = raw.select("id", F.expr("entities.hashtags.text").alias("hashtags"))
    assert sorted(map(str, enrich_by_lookup(raw, side).collect())) == sorted(map(str, enrich(raw).collect()))


def test_self_join_multiplies_what_the_projection_keeps(spark):
    raw = spark.createDataFrame([post(1), post(2), post(2), post(None)], POST)
    side = raw.select("id", F.expr("entities.hashtags.text").alias("hashtags"))
    assert raw.join(side, "id").count() == 5
    assert enrich(raw).count() == 4


def envelopes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_encode_leaves_nulls_out(spark):
    df = spark.createDataFrame([(None, None, None, [], None), (None, None, None, None, "x")], ENVELOPE)
    assert [r.value for r in encode(df).collect()] == ['{"hashtags":[]}', '{"cleaned_text":"x"}']


def test_encode_writes_utc_in_any_zone(spark, conf):
    conf("spark.sql.session.timeZone", "America/Denver")
    df = spark.range(1).select(F.timestamp_seconds(F.lit(1378970100)).alias("created_at"))
    assert encode(df).first().value == '{"created_at":"2013-09-12T07:15:00.000Z"}'


def test_decode(spark):
    rows = decode(envelopes(
        spark, '{"created_at":"z"}', '{"created_at":"z","coordinates":["a"],"cleaned_text":"ok"}',
        '{"created_at":1,"extra":2,"coordinates":[1,2.5]}', '{"id":7}',
    )).collect()
    assert [tuple(r) for r in rows] == [
        (None, "z", None, None, None), (None, "z", None, None, "ok"),
        (None, "1", [1.0, 2.5], None, None), (7, None, None, None, None),
    ]


def test_rejects(spark):
    bad = ["{bad", None, "", "[]", "{}", '{"other":1}']
    decoded = decode(envelopes(spark, *bad, '{"id":1}', '{"created_at":"z","coordinates":["a"]}'), keep_json=True)
    assert [r.json for r in rejected(decoded).collect()] == bad
    assert accepted(decoded).count() == 2 and accepted(decoded).columns == ENVELOPE.fieldNames()


ROW = st.tuples(
    st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)),
    st.one_of(st.none(), st.datetimes(dt.datetime(1970, 1, 2), dt.datetime(2100, 1, 1)).map(
        lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000, tzinfo=UTC))),
    st.one_of(st.none(), st.lists(st.floats(-180, 180), max_size=3)),
    st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=5)), max_size=3)),
    st.one_of(st.none(), st.text(max_size=20)),
).filter(lambda r: any(v is not None for v in r))


@settings(max_examples=10, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=30))
def test_round_trip(spark, rows):
    clean = lambda s: None if s is None else s.encode("utf-8", "ignore").decode()
    rows = [(a, b, c, None if d is None else [clean(t) for t in d], clean(e)) for a, b, c, d, e in rows]
    types = "id long, created_at timestamp, coordinates array<double>, hashtags array<string>, cleaned_text string"
    df = spark.createDataFrame(rows, types)
    sent = encode(df).select(F.col("value").cast("binary").alias("value"))
    back = restore_time(accepted(decode(sent, keep_json=True)))
    key = lambda r: repr(tuple(r))
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)


def test_process_and_compat_columns(spark):
    raw = spark.createDataFrame([post(1, "good #x"), post(2, None, place=None)], POST)
    label = lambda df: df.withColumn("sentiment_result", F.when(F.col("cleaned_text").isNotNull(), F.array(F.lit("pos"))))
    done = process(enrich(raw), label)
    assert [f.dataType for f in done.schema] == [f.dataType for f in PROCESSED]
    assert done.columns == PROCESSED.fieldNames()
    one, two = done.orderBy("id").collect()
    assert (one.lat, one.lon, one.text, one.sentiment_score) == (40.0, -105.0, "good ", 1)
    assert (two.lat, two.lon, two.text, two.sentiment_score) == (None, None, None, None)
    five = compat_columns(done).orderBy("created_at", "text")
    assert five.columns == ["created_at", "coordinates", "hashtags", "text", "sentiment_score"]
    assert five.first().created_at == "2013-09-12T07:15:00.000Z"


def test_annotation_labels(spark):
    df = spark.createDataFrame([([("pos", 1), ("neg", 2)],)], "sentiment array<struct<result:string,begin:int>>")
    assert annotation_labels(df).first().sentiment_result == ["pos", "neg"]
