"""The space-filling curve, box searches along it, and nearest posts, against plain work."""

import datetime as dt
import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postflow.functions.curve import LEVELS, box_ranges, cell_at, cell_corner, curve_key, in_ranges
from postflow.operators import search
from postflow.operators.nearest import nearest_posts
from postflow.schema import PROCESSED
from postflow.sources.layout import read_layout, write_layout
from test_search import make_rows

UTC = dt.timezone.utc
BOXES = {
    "tall": (-85.0, 10.0, 85.0, 13.0), "wide": (-30.0, -60.0, 30.0, 60.0), "dateline": (-50.0, 165.0, 50.0, -165.0),
    "tall dateline": (-80.0, 179.0, 80.0, -179.0), "small": (10.0, 10.0, 10.5, 10.5), "globe": (-90.0, -180.0, 90.0, 180.0),
    "point": (5.0, 7.0, 5.0, 7.0), "none": (10.0, 0.0, 9.0, 1.0),
}


def plain_key(lat, lon):
    steps = 1 << LEVELS
    row = max(0, min(steps - 1, math.floor((lat + 90) / 180 * steps)))
    column = max(0, min(steps - 1, math.floor((lon + 180) / 360 * steps)))
    return sum((row >> b & 1) << (2 * b + 1) | (column >> b & 1) << (2 * b) for b in range(LEVELS))


def points(n=2000, seed=3):
    rng = random.Random(seed)
    out = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    return out + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (0.0, 180.0), (5.0, 7.0), (91.0, 200.0), (10.0, 10.0), (10.5, 10.5)]


def test_keys(spark):
    df = spark.createDataFrame(points() + [(None, 1.0), (1.0, None)], "lat double, lon double")
    key = curve_key(F.col("lat"), F.col("lon"))
    south, west, height, width = cell_corner(cell_at(key, 6), 6)
    rows = df.select("lat", "lon", key.alias("key"), south.alias("s"), west.alias("w")).collect()
    for r in rows:
        if r.lat is None or r.lon is None:
            assert r.key is None
        else:
            assert r.key == plain_key(r.lat, r.lon)
            if abs(r.lat) < 90 and abs(r.lon) < 180:
                assert r.s <= r.lat < r.s + height and r.w <= r.lon < r.w + width


@pytest.mark.parametrize("most", [1, 4, 16, 64])
def test_ranges_hold_every_point_of_the_box(most):
    for name, (s, w, n, e) in BOXES.items():
        ranges = box_ranges(s, w, n, e, most)
        assert len(ranges) <= most and all(a <= b for a, b in ranges) and (ranges or name == "none")
        for lat, lon in points():
            if s <= lat <= n and (w <= lon <= e if w <= e else lon >= w or lon <= e):
                assert any(a <= plain_key(lat, lon) <= b for a, b in ranges), (name, lat, lon)
    share = lambda box, m: sum(b - a + 1 for a, b in box_ranges(*box, m)) / (1 << 2 * LEVELS)
    assert share(BOXES["globe"], 4) == 1.0 and share(BOXES["tall"], 16) < 0.15 and share(BOXES["small"], 16) < 1e-3


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(8)
    rows = []
    for i, (lat, lon) in enumerate(points(6000, 9)[:6000]):
        rows.append((i, dt.datetime(2024, 1, 1, rng.randrange(24), tzinfo=UTC), [lat, lon], lat, lon, [], "x", 0))
    rows.append((6001, dt.datetime(2024, 1, 1, tzinfo=UTC), None, None, None, [], "x", 0))
    return spark.createDataFrame(rows, PROCESSED).repartition(4).cache()


def groups_read(path, box, ranges):
    """Row groups whose statistics do not rule the box out."""
    s, w, n, e = box
    read = total = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            lat, lon, curve = columns["lat"], columns["lon"], columns["curve"]
            total += 1
            if lat is None or not lat.has_min_max:
                continue
            meets = lat.min <= n and lat.max >= s and (
                lon.min <= e and lon.max >= w if w <= e else lon.max >= w or lon.min <= e)
            read += meets and (ranges is None or any(curve.min <= b and curve.max >= a for a, b in ranges))
    return read, total


def test_boxes_read_fewer_row_groups_than_by_rows_of_cells(spark, conf, posts, tmp_path):
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    paths = {c: str(tmp_path / c) for c in ("cell", "curve")}
    for cluster, path in paths.items():
        write_layout(posts, path, cluster=cluster)
    stored = read_layout(spark, paths["curve"])
    for name, box in BOXES.items():
        want = sorted(r.id for r in search.box_search(posts, *box).select("id").collect())
        found = search.curve_box_search(stored, *box)
        assert sorted(r.id for r in found.select("id").collect()) == want
        if name in ("tall", "wide", "dateline", "tall dateline"):
            by_cell, total = groups_read(paths["cell"], box, None)
            by_curve, same = groups_read(paths["curve"], box, box_ranges(*box))
            assert total == same > 50 and by_curve < by_cell, (name, by_curve, by_cell)
    conf("spark.sql.maxMetadataStringLength", "10000")
    pushed = plan_of(search.curve_box_search(stored, *BOXES["tall"])).split("PushedFilters")[-1]
    assert "Or(" in pushed and "(curve," in pushed
    with pytest.raises(ValueError):
        write_layout(posts, paths["cell"], cluster="row")


# --- nearest posts ------------------------------------------------------------------------


def km(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def brute(rows, centers, k):
    out = {}
    for c, a, b in centers:
        if a is None or b is None or c is None:
            continue
        near = sorted({(round(km((a, b), (lat, lon)), 6), i) for i, lat, lon in rows if None not in (i, lat, lon) and i != c})[:k]
        out.update({(c, n): (i, d) for n, (d, i) in enumerate(near, 1)})
    return out


def found(df, centers, k):
    rows = nearest_posts(df, centers, k).collect()
    got = {(r.center_id, r["rank"]): (r.id, r.distance_km) for r in rows}
    assert len(got) == len(rows)
    return got


def same(got, want):
    assert got.keys() == want.keys()
    for key, (i, d) in want.items():
        assert got[key][0] == i and abs(got[key][1] - d) < 2e-6, (key, got[key], want[key])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lat double, lon double")


def test_nearest_posts_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, *p) for i, p in enumerate(points(400, 5)[:400])]
    rows += [(1000 + i, 40.0 + rng.gauss(0, 0.01), -105.0 + rng.gauss(0, 0.01)) for i in range(300)]  # a town
    rows += [(2000 + i, 40.0, -105.0) for i in range(60)]  # one spot
    rows += [(3000, 89.9, 10.0), (3001, 89.9, -170.0), (3002, 90.0, 0.0), (3003, -90.0, 50.0), (3004, 0.0, 180.0), (3005, 0.0, -180.0), (3006, 0.0, 179.9)]
    rows += [(4000, None, 1.0), (4001, 1.0, None), (None, 2.0, 2.0), (7, *rows[7][1:])]
    centers = [r for r in rows if r[0] is None or r[0] % 9 == 0 or r[0] >= 3000]
    centers = list(dict.fromkeys(centers)) + [(-5, 40.0, -105.0), (-6, -40.0, 75.0)]
    for k in (1, 5, 70):
        same(found(frame(spark, rows), frame(spark, centers), k), brute(rows, centers, k))


def test_fewer_posts_than_wanted(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 90.0), (3, 50.0, -120.0)]
    same(found(frame(spark, rows), frame(spark, rows), 10), brute(rows, rows, 10))
    assert found(frame(spark, []), frame(spark, rows), 3) == found(frame(spark, rows), frame(spark, []), 3) == {}


def test_no_cross_join(spark):
    df = frame(spark, [(i, *p) for i, p in enumerate(points(50, 5)[:50])])
    plan = plan_of(nearest_posts(df, df, 3))
    assert not any(word in plan for word in ("NestedLoop", "Cartesian", "Python"))


def test_stored_posts_are_not_written_again(spark, tmp_path, monkeypatch):
    """The curve's layout is made straight from the stored processed posts, with the same rows."""
    from postflow.sources import layout

    posts = spark.createDataFrame(list(make_rows(300, 4)), PROCESSED)
    write_layout(posts, str(tmp_path / "cell"))
    stored = read_layout(spark, str(tmp_path / "cell"))
    made = []
    real = layout.new_folder
    monkeypatch.setattr(layout, "new_folder", lambda *args: made.append(args) or real(*args))
    write_layout(stored, str(tmp_path / "curve"), cluster="curve", stored=True)
    rows = lambda df: sorted(map(str, df.select(*PROCESSED.fieldNames()).collect()))
    assert not made and rows(read_layout(spark, str(tmp_path / "curve"))) == rows(posts)
