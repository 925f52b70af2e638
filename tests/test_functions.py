"""Scalar functions against fixed rows."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postflow.functions import geo
from postflow.functions.score import sentiment_score
from postflow.functions.text import clean_text, has_terms, normal_terms, tokens
from postflow.functions.times import instant_literal, parse_post_time, utc_date


def one(spark, values, kind, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column.alias("r")).collect()]


def test_clean_text(spark):
    values = ["Rain http://t.co/x #storm @bob mail a@b.com HTTP://Y http", "#only", None, "a@b.com", ""]
    want = ["Rain    mail a HTTP://Y http", "", None, "a", ""]
    assert one(spark, values, "string", clean_text(F.col("v"))) == want


def test_tokens(spark):
    got = one(spark, ["It's  ÉTÉ, 42x_y 日本!", "", None], "string", tokens(F.col("v")))
    assert got == [["it", "s", "été", "42x", "y", "日本"], [], None]


WORDS = st.lists(st.sampled_from(["a", "ba", "ab", "aba", "A", "b-a", "é", "aé", "a1", "", "\n"]), max_size=8)


@settings(max_examples=10, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_has_terms_equals_token_membership(spark, texts):
    values = [" ".join(t) for t in texts]
    for terms in (["a"], ["a", "ba"], ["é", "aba", "b"]):
        as_set = tokens(F.col("v"))
        for every in (False, True):
            want = F.size(F.array_intersect(as_set, F.array(*map(F.lit, terms)))) >= (len(terms) if every else 1)
            assert one(spark, values, "string", has_terms(F.col("v"), terms, every) == want) == [True] * len(values)


def test_terms_must_be_words():
    assert normal_terms(["Rain", "rain", "Été"]) == ["rain", "été"]
    for bad in (["a b"], ["a.*"], [""], [], ["a_b"]):
        with pytest.raises(ValueError):
            normal_terms(bad)


TIMES = {
    "Thu Sep 12 07:15:00 +0000 2013": 1378970100,
    "Fri Sep 13 07:15:00 -0600 2013": 1379078100,
    "Thu Sep 5 07:15:00 +0000 2013": 1378365300,
    "Thu Sep 12 7:5:0 +0000 2013": 1378969500,
    "Thursday Sep 12 07:15:00 +0000 2013": 1378970100,
    "Thu September 12 07:15:00 +0000 2013": 1378970100,
    "thu sep 12 07:15:00 +0000 2013": 1378970100,
    "Thu Sep 12 07:15:00 +0000 2013 and more": 1378970100,
    "Thu Sep 12 07:15:00 +0000 2013abc": 1378970100,
    "Thu Sep 12 07:15:00 GMT 2013": 1378970100,
    "Thu Sep 12 07:15:00 PST 2013": 1378998900,
    "Thu Sep 12 07:15:00 mdt 2013": 1378991700,
    "Mon Feb 29 07:15:00 +0000 2016": 1456730100,
    "Thu Sep 012 007:15:00 +0000 2013": 1378970100,
    "Sat Dec 31 23:59:59 -1100 2016": 1483268399,
    "bad": None,
    "": None,
    None: None,
    "Thu Sep 32 07:15:00 +0000 2013": None,
    "Thu Sep 12 25:15:00 +0000 2013": None,
    "Thu Sep 12 07:61:00 +0000 2013": None,
    "Sun Feb 29 07:15:00 +0000 2015": None,
    "Mon Sep 12 07:15:00 +0000 2013": None,
    "Xyz Sep 12 07:15:00 +0000 2013": None,
    "Thuxyz Sep 12 07:15:00 +0000 2013": None,
    "Thu Septem 12 07:15:00 +0000 2013": None,
    "Thu Sep 12 07:15:00 +05:30 2013": None,
    " Thu Sep 12 07:15:00 +0000 2013": None,
    "Thu Sep 12 07:15:00 +0000 13": None,
    "Thu  Sep 12 07:15:00 +0000 2013": None,
    "Thu Sep 12 07:15:00 XQZ 2013": None,
    "Thu Sep 12 07:15:00 +2500 2013": None,
    "Thu Sep 12 07:15:00 +0075 2013": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/Denver", "Asia/Kolkata"])
def test_parse_time_in_any_zone(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    got = one(spark, list(TIMES), "string", F.unix_seconds(parse_post_time(F.col("v"))))
    assert dict(zip(TIMES, got)) == TIMES


def test_parse_time_equals_the_legacy_parser(spark, conf):
    """The legacy parser, ANSI off, is the behaviour to match on numeric and RFC 822 zones."""
    doubled = "Thu  Sep 12 07:15:00 +0000 2013"
    texts = [t for t in TIMES if t != doubled]
    ours = one(spark, texts, "string", F.unix_seconds(parse_post_time(F.col("v"))))
    conf("spark.sql.legacy.timeParserPolicy", "LEGACY")
    conf("spark.sql.ansi.enabled", "false")
    legacy = one(spark, texts, "string", F.unix_seconds(F.to_timestamp("v", "EEE MMM dd HH:mm:ss ZZZ yyyy")))
    assert dict(zip(texts, ours)) == dict(zip(texts, legacy))


def test_utc_date_ignores_the_session_zone(spark, conf):
    conf("spark.sql.session.timeZone", "America/Denver")
    got = one(spark, [0], "long", utc_date(instant_literal("2024-01-02T00:30:00")).cast("string"))
    assert got == ["2024-01-02"]
    assert one(spark, [0], "long", F.unix_seconds(instant_literal("2024-01-02T01:00:00+01:00"))) == [1704153600]


SCORES = [
    (["pos"], 1), (["neg", "neg"], -2), (["neutral"], 0), ([], 0),
    (["[pos, neg, pos]"], 1), ([" [pos] "], 1), (["POS"], 0), (["[ pos"], 0), (["[[pos]"], 0),
    (None, None), ([None, "pos"], 1), (["\tpos"], 1), (["pos,"], 1), (["\x00pos\x1f"], 1),
    (["pos "], 0), (["neg]"], -1), (["[neg,pos],[neg]"], -1), ([""], 0), (["pos]\n"], 1),
]


def test_score(spark):
    got = one(spark, [v for v, _ in SCORES], "array<string>", sentiment_score(F.col("v")))
    assert got == [w for _, w in SCORES]


def python_km(lat1, lon1, lat2, lon2):
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def test_box_around_holds_the_circle(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)]
    df = spark.createDataFrame(points, "lat double, lon double").cache()
    for lat0, lon0, km in [(0, 0, 500), (10, 179, 3000), (-40, -179.5, 800), (89, 20, 400), (-88, 0, 5000), (60, 30, 6000)]:
        want = {p for p in points if python_km(*p, lat0, lon0) <= km}
        box = geo.box_around(lat0, lon0, km)
        inside = {tuple(r) for r in df.where(geo.in_box(F.col("lat"), F.col("lon"), *box)).collect()}
        exact = {tuple(r) for r in df.where(geo.distance_km(F.col("lat"), F.col("lon"), lat0, lon0) <= km).collect()}
        assert want <= inside
        assert exact == want


def test_coordinate_order(spark):
    values = [[1.0, 2.0], [1.0], [], None]
    for order, want in (("lat,lon", [(1.0, 2.0), (1.0, None), (None, None), (None, None)]),
                        ("lon,lat", [(2.0, 1.0), (None, 1.0), (None, None), (None, None)])):
        got = one(spark, values, "array<double>", F.struct(*geo.lat_lon(F.col("v"), order)))
        assert [tuple(r) for r in got] == want
    with pytest.raises(ValueError):
        geo.lat_lon(F.col("v"), "x,y")


def test_cells_of_negative_coordinates(spark):
    df = spark.createDataFrame([(-0.5, 10.0), (0.5, -180.0), (None, None)], "lat double, lon double")
    assert [tuple(r) for r in df.select(*geo.cell(F.col("lat"), F.col("lon"), 1.0)).collect()] == [
        (-1, 10), (0, -180), (None, None)]
