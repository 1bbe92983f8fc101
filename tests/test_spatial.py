import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrain.operators import spatial as sp


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(3)
    segs = [(i, i + 1, *map(float, rng.uniform(0, 50, 4))) for i in range(40)]
    pts = [(i, *map(float, rng.uniform(-5, 55, 2))) for i in range(300)]
    return (segs, pts, spark.createDataFrame(segs, "u int, v int, x1 double, y1 double, x2 double, y2 double"),
            spark.createDataFrame(pts, "id int, x double, y double"))


def _dist(s, p):
    a, b, q = np.array(s[2:4]), np.array(s[4:6]), np.array(p[1:])
    t = np.clip(np.dot(q - a, b - a) / np.dot(b - a, b - a), 0, 1)
    return float(np.linalg.norm(q - a - t * (b - a)))


@pytest.mark.parametrize("reach,size", [(1.0, None), (3.0, 2.0), (0.5, 30.0)])
def test_points_near_links(plane, reach, size):
    segs, pts, links, points = plane
    got = {(r["u"], r["id"]) for r in sp.points_near_links(points, links, reach, size).collect()}
    want = {(s[0], p[0]) for s in segs for p in pts if _dist(s, p) <= reach}
    assert got == want and want


def test_zero_reach_matches_nothing(plane):
    _, _, links, points = plane
    assert sp.points_near_links(points, links, 0.0).count() == 0


def test_nearest_link_by_largest_distance(plane):
    segs, pts, links, points = plane
    got = {r["id"]: (r["u"], r["dist"]) for r in
           sp.nearest_link(points, links, 2.0, "id").collect()}
    assert len(got) == len(pts)
    for p in pts:
        far = {s[0]: max(math.dist(p[1:], s[2:4]), math.dist(p[1:], s[4:6])) for s in segs}
        assert got[p[0]][1] == pytest.approx(min(far.values()))


def test_nearest_link_ends_with_unusable_coordinates(spark):
    links = spark.createDataFrame([(1, 2, 0.0, 0.0, 1.0, 0.0), (3, 4, float("nan"), 0.0, 1.0, 1.0), (5, 6, None, 0.0, 1.0, 1.0)],
                                  "u int, v int, x1 double, y1 double, x2 double, y2 double")
    stations = spark.createDataFrame([(1, 0.5, 9.0), (2, float("nan"), 0.0), (3, None, 0.0), (4, float("inf"), 1.0)],
                                     "station_id int, x double, y double")
    assert [(r.station_id, r.u) for r in sp.match_stations(stations, links, 0.5).collect()] == [(1, 1)]


def test_polygons_against_sampling(spark, plane):
    segs, _, links, _ = plane
    ring = [(10.0, 10.0), (30.0, 12.0), (34.0, 30.0), (20.0, 22.0), (8.0, 35.0)]
    blocks = spark.createDataFrame([(1, 5.0, ring)], "block_id int, attr double, ring array<struct<x:double,y:double>>")
    low = blocks.unionByName(spark.createDataFrame(
        [(0, 1.0, [(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)])], blocks.schema))
    got = {r["u"]: r["attr"] for r in sp.links_in_polygons(links, low, ["attr"], 5.0).collect()}

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit
    for s in segs:
        t = np.linspace(0, 1, 4001)
        touch = any(inside(s[2] + k * (s[4] - s[2]), s[3] + k * (s[5] - s[3])) for k in t)
        assert got[s[0]] == (5.0 if touch else 3.0)


def test_projection_of_the_false_origin(spark):
    df = spark.createDataFrame([(-119.0, 35.0 + 1 / 3)], "lon double, lat double")
    r = sp.project(df).first()
    assert r["x"] == pytest.approx(6561666.667, abs=0.01)
    assert r["y"] == pytest.approx(1640416.667, abs=0.01)


def test_projection_keeps_distances(spark):
    df = spark.createDataFrame([(-119.8, 36.7), (-119.8, 36.71)], "lon double, lat double")
    a, b = sp.project(df).collect()
    feet = math.dist((a["x"], a["y"]), (b["x"], b["y"]))
    assert feet == pytest.approx(0.01 * 110_970 / 0.3048, rel=2e-3)


def test_rotation_round_trip(spark, plane):
    _, _, _, points = plane
    back = sp.rotate(sp.rotate(points, 37, (3, 4)), -37, (3, 4)).orderBy("id").collect()
    for r, p in zip(back, points.orderBy("id").collect()):
        assert r["x"] == pytest.approx(p["x"]) and r["y"] == pytest.approx(p["y"])


def test_segment_match_prefers_clear_direction(spark):
    links = spark.createDataFrame([(1, 2, 0.0, 0.0, 10.0, 2.0)],
                                  "u int, v int, x1 double, y1 double, x2 double, y2 double")
    segs = spark.createDataFrame(
        [(7, "N", 5.0, 0.0, 5.0, 3.0), (8, "E", 4.0, 1.5, 6.0, 1.5), (9, "W", 5.0, 1.0, 6.0, 1.0),
         (5, "E", 4.0, 0.5, 6.0, 0.5)],
        "segment_id int, bearing string, x1 double, y1 double, x2 double, y2 double")
    r = sp.match_segments(links, segs, 1.0).first()
    assert r["segment_id"] == 5 and r["confidence"] == pytest.approx(10 / 12)


def test_last_polygon_wins_and_mean_fills(spark):
    links = spark.createDataFrame([(1, 2, 1.0, 1.0, 2.0, 2.0), (3, 4, 80.0, 80.0, 81.0, 81.0)],
                                  "u int, v int, x1 double, y1 double, x2 double, y2 double")
    sq = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
    blocks = spark.createDataFrame([(1, 10.0, sq), (2, 30.0, sq)],
                                   "block_id int, attr double, ring array<struct<x:double,y:double>>")
    got = {r["u"]: r["attr"] for r in sp.links_in_polygons(links, blocks, ["attr"], 4.0).collect()}
    assert got == {1: 30.0, 3: 20.0}
    assert links.where(F.col("u") > 0).count() == 2


def test_cells_grow_with_the_length_of_a_segment(spark):
    rows = [(i, n * math.cos(a), n * math.sin(a)) for i, (n, a) in enumerate(
        (n, a) for n in (50.0, 100.0, 200.0) for a in (0.0, 0.7, math.pi / 4, 1.5, math.pi / 2, 2.5, -1.0))]
    links = spark.createDataFrame([(i, i, 0.25, 0.25, 0.25 + x, 0.25 + y) for i, x, y in rows],
                                  "u int, v int, x1 double, y1 double, x2 double, y2 double")
    plain = sp.segment_cells(links, 1.0, 1.0)
    got = {}
    for r in plain.select("u", "_cx", "_cy").collect():
        got.setdefault(r["u"], set()).add((r["_cx"], r["_cy"]))
    assert plain.count() == sum(map(len, got.values()))
    for i, x, y in rows:
        length = math.hypot(x, y)
        assert len(got[i]) <= 8 * length + 40
        for t in range(201):
            px, py = 0.25 + x * t / 200, 0.25 + y * t / 200
            assert {(math.floor(px + dx), math.floor(py + dy)) for dx, dy in ((0, 0), (0.99, 0), (-0.7, 0.7))} <= got[i]
