"""Spatial queries: points near links, polygons, segments, stations, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spatial as sp
from .bindings import network, table, view, with_views
from .common import r, rounded
from .registry import query

C = F.col

_DX, _DY = "(l.x2 - l.x1)", "(l.y2 - l.y1)"
_T = (f"least(greatest(((p.x - l.x1) * {_DX} + (p.y - l.y1) * {_DY}) "
      f"/ ({_DX} * {_DX} + {_DY} * {_DY}), 0), 1)")
DIST = (f"sqrt(pow(p.x - l.x1 - {_T} * {_DX}, 2) + pow(p.y - l.y1 - {_T} * {_DY}, 2))")


def near_sql(points: str, reach: float, columns: str) -> str:
    return f"SELECT {columns} FROM {points} p JOIN links l ON {DIST} <= {reach}"


@query("G01_incidents_near_links", with_views(
    near_sql("incidents", 0.9123, f"l.u, l.v, p.event_id, {r(DIST, 'dist')}"), "links", "incidents"))
def g01(spark, sf):
    out = sp.points_near_links(view(spark, sf, "incidents"), network(spark, sf).links, 0.9123)
    return rounded(out.select("u", "v", "event_id", "dist"))


def _count_sql(points: str, reach: float, name: str) -> str:
    return with_views(
        f"SELECT l.u, l.v, CAST(coalesce(h.n, 0) AS BIGINT) AS {name} FROM links l LEFT JOIN "
        "(SELECT u, v, count(*) AS n FROM hits GROUP BY u, v) h ON h.u = l.u AND h.v = l.v",
        "links", points, hits=near_sql(points, reach, "l.u, l.v"))


@query("G01_incident_counts", _count_sql("incidents", 0.9123, "incidents"))
def g01_counts(spark, sf):
    return sp.count_near_links(view(spark, sf, "incidents"), network(spark, sf).links, 0.9123,
                               "incidents")


@query("G02_stop_counts", _count_sql("points", 1.5123, "bus_stops"))
def g02(spark, sf):
    return sp.count_near_links(view(spark, sf, "points"), network(spark, sf).links, 1.5123,
                               "bus_stops")


@query("G03_intersection_counts", _count_sql("stations", 2.0123, "intersections"))
def g03(spark, sf):
    return sp.count_near_links(view(spark, sf, "stations"), network(spark, sf).links, 2.0123,
                               "intersections")


# squares of the node plane with the balance of the customers in them
BLOCKS = """
SELECT gx * 10 + gy AS block_id, gx * 10.1 - 0.037 AS x0, gy * 9.7 - 0.041 AS y0, attr
FROM (SELECT c_custkey % 10 AS gx, (c_custkey // 10) % 10 AS gy, avg(c_acctbal) AS attr
      FROM customer GROUP BY 1, 2)"""


def blocks(spark, sf):
    df = table(spark, sf, "customer").groupBy(
        (C("c_custkey") % 10).alias("gx"), (F.floor(C("c_custkey") / 10) % 10).alias("gy")).agg(
        F.avg("c_acctbal").alias("attr"))
    x0, y0 = C("gx") * 10.1 - 0.037, C("gy") * 9.7 - 0.041
    corner = [(x0, y0), (x0 + 10.1, y0), (x0 + 10.1, y0 + 9.7), (x0, y0 + 9.7)]
    return df.select((C("gx") * 10 + C("gy")).alias("block_id"), "attr",
                     F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corner])
                     .alias("ring"))


def _clip(d: str, near: str, far: str) -> tuple[str, str]:
    """Entry and exit of a segment in a slab, as SQL."""
    return (f"CASE WHEN {d} = 0 THEN (CASE WHEN {near} <= 0 AND {far} >= 0 THEN 0 ELSE 2 END) "
            f"ELSE least({near} / {d}, {far} / {d}) END",
            f"CASE WHEN {d} = 0 THEN (CASE WHEN {near} <= 0 AND {far} >= 0 THEN 1 ELSE -1 END) "
            f"ELSE greatest({near} / {d}, {far} / {d}) END")


_X = _clip(_DX, "(b.x0 - l.x1)", "(b.x0 + 10.1 - l.x1)")
_Y = _clip(_DY, "(b.y0 - l.y1)", "(b.y0 + 9.7 - l.y1)")


@query("G04_links_in_polygons", with_views(f"""
SELECT l.u, l.v, {r("coalesce(h.attr, (SELECT avg(attr) / 1000 FROM blocks))", "attr")}
FROM links l LEFT JOIN (
  SELECT l.u, l.v, arg_max(b.attr / 1000, b.block_id) AS attr FROM links l JOIN blocks b
  ON greatest({_X[0]}, {_Y[0]}, 0) <= least({_X[1]}, {_Y[1]}, 1) GROUP BY l.u, l.v) h
ON h.u = l.u AND h.v = l.v""", "links", blocks=BLOCKS.replace("gx * 10.1", "CAST(gx AS DOUBLE) * 10.1")
    .replace("gy * 9.7", "CAST(gy AS DOUBLE) * 9.7")))
def g04(spark, sf):
    return rounded(sp.links_in_polygons(network(spark, sf).links, blocks(spark, sf), ["attr"],
                                        10.0, scale=0.001))


SEGMENTS = """
SELECT o_orderkey AS segment_id, substr('NSEW', CAST(1 + o_custkey % 4 AS INTEGER), 1) AS bearing,
       CAST((o_orderkey * 31) % 997 AS DOUBLE) / 10 AS x1, CAST((o_orderkey * 17) % 953 AS DOUBLE) / 10 AS y1,
       CAST((o_orderkey * 31) % 997 AS DOUBLE) / 10 + (o_custkey % 7) - 3.1 AS x2,
       CAST((o_orderkey * 17) % 953 AS DOUBLE) / 10 + (o_custkey % 5) - 2.3 AS y2
FROM orders"""


def segments(spark, sf):
    return spark.sql(SEGMENTS.replace("FROM orders", "FROM {orders}"),
                     orders=table(spark, sf, "orders"))


_MIDS = """
SELECT u, v, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y,
       CASE WHEN y2 > y1 THEN 'N' ELSE 'S' END AS ns, CASE WHEN x2 > x1 THEN 'E' ELSE 'W' END AS ew,
       coalesce(abs(y2 - y1) / nullif(abs(x2 - x1) + abs(y2 - y1), 0), 0) AS nc,
       coalesce(abs(x2 - x1) / nullif(abs(x2 - x1) + abs(y2 - y1), 0), 0) AS ec FROM links"""


@query("G05_match_segments", with_views(f"""
SELECT m.u, m.v, b.segment_id, {r("b.conf", "confidence")} FROM mids m LEFT JOIN (
  SELECT u, v, segment_id, conf, row_number() OVER (PARTITION BY u, v ORDER BY conf DESC, segment_id) AS rk
  FROM (SELECT p.u, p.v, l.segment_id,
               CASE WHEN l.bearing = p.ns THEN p.nc WHEN l.bearing = p.ew THEN p.ec END AS conf
        FROM mids p JOIN segs l ON {DIST} <= 1.0123) WHERE conf > 0) b
ON b.u = m.u AND b.v = m.v AND b.rk = 1""", "links", mids=_MIDS, segs=SEGMENTS))
def g05(spark, sf):
    return rounded(sp.match_segments(network(spark, sf).links, segments(spark, sf), 1.0123))


_H = ("greatest(sqrt(pow(p.x - l.x1, 2) + pow(p.y - l.y1, 2)), "
      "sqrt(pow(p.x - l.x2, 2) + pow(p.y - l.y2, 2)))")


@query("G06_match_stations", with_views(f"""
SELECT station_id, u, v, {r("dist", "dist")} FROM (
  SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY dist, station_id) AS k2 FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY dist, u, v) AS k1 FROM (
      SELECT p.station_id, l.u, l.v, round({_H}, 9) AS dist FROM stations p, links l)) WHERE k1 = 1)
WHERE k2 = 1""", "links", "stations"))
def g06(spark, sf):
    return rounded(sp.match_stations(view(spark, sf, "stations"), network(spark, sf).links, 10.0))


@query("G07_inside_extent", with_views("""
SELECT c_custkey FROM points, (SELECT min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b,
  min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM links)
WHERE x > a AND x < b AND y > c AND y < d""", "points", "links"))
def g07(spark, sf):
    return sp.inside_extent(view(spark, sf, "points"), network(spark, sf).links).select("c_custkey")


@query("G08_cardinal", with_views(f"""
SELECT u, v, ns, ew, {r("nc", "ns_confidence")}, {r("ec", "ew_confidence")},
       {r("(SELECT length FROM links l WHERE l.u = m.u AND l.v = m.v)", "crs_distance")}
FROM mids m""", "links", mids=_MIDS))
def g08(spark, sf):
    return rounded(sp.cardinal(network(spark, sf).links).select(
        "u", "v", "ns", "ew", "crs_distance", "ns_confidence", "ew_confidence"))


def _points(spark, sf):
    return view(spark, sf, "points").withColumnRenamed("c_custkey", "node")


def _point_query(name: str, x: str, y: str, fn, sql_from: str = "points"):
    query(name, with_views(f"SELECT c_custkey AS node, {r(x, 'x')}, {r(y, 'y')} FROM {sql_from}",
                           "points"))(lambda spark, sf: rounded(fn(_points(spark, sf)).select(
                               "node", "x", "y")))


_COS, _SIN = repr(math.cos(math.radians(30))), repr(math.sin(math.radians(30)))
_IN = "x > 20 AND x < 70 AND y > 10 AND y < 60"
_point_query("G09_mirror_x", "2 * (SELECT max(x) FROM points) - x", "y", lambda d: sp.mirror(d, "x"))
_point_query("G09_mirror_y", "x", "2 * (SELECT max(y) FROM points) - y", lambda d: sp.mirror(d, "y"))
_point_query(
    "G10_rotate", f"CASE WHEN {_IN} THEN (x - 5) * {_COS}::DOUBLE - (y - 6) * {_SIN}::DOUBLE + 5 ELSE x END",
    f"CASE WHEN {_IN} THEN (x - 5) * {_SIN}::DOUBLE + (y - 6) * {_COS}::DOUBLE + 6 ELSE y END",
    lambda d: sp.rotate(d, 30, (5, 6), (20, 10, 70, 60)))
_point_query("G10_rotate_90", "-y", "x", lambda d: sp.rotate(d, 90))
_point_query("G10_rotate_180", "-x", "-y", lambda d: sp.rotate(d, 180))
_point_query("G11_rescale", "x * 1.3::DOUBLE", "y * 1.3::DOUBLE", lambda d: sp.rescale(d, 1.3))
_point_query(
    "G11_shift_to_base",
    f"CASE WHEN {_IN} THEN x + 100 - (SELECT x FROM points WHERE c_custkey = 7) ELSE x END",
    f"CASE WHEN {_IN} THEN y + 50 - (SELECT y FROM points WHERE c_custkey = 7) ELSE y END",
    lambda d: sp.shift_to_base(d, 7, (100, 50), (20, 10, 70, 60)))


@query("G12_nodes_from_links", with_views("""
SELECT node, x, y FROM (
  SELECT node, x, y, row_number() OVER (PARTITION BY node ORDER BY rk DESC, x DESC, y DESC) AS n FROM (
    SELECT u AS node, 0 AS rk, x1 AS x, y1 AS y FROM links UNION ALL
    SELECT v, 1, x2, y2 FROM links)) WHERE n = 1""", "links"))
def g12(spark, sf):
    return sp.nodes_from_links(network(spark, sf).links)


def _lcc_sql() -> tuple[str, str]:
    z = sp.ZONE
    e = math.sqrt(2 * z["f"] - z["f"] ** 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = (math.radians(z[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = z["a"] * m(p1) / (n * t(p1) ** n)
    es = f"({e!r}::DOUBLE * sin(radians(lat)))"
    ts = (f"(tan({math.pi / 4!r}::DOUBLE - radians(lat) / 2) "
          f"/ pow((1 - {es}) / (1 + {es}), {e / 2!r}::DOUBLE))")
    rho, turn = f"({big!r}::DOUBLE * pow({ts}, {n!r}::DOUBLE))", f"({n!r}::DOUBLE * radians(lon + 119))"
    return (f"({z['fe']!r}::DOUBLE + {rho} * sin({turn})) / {z['unit']!r}::DOUBLE",
            f"({z['fn']!r}::DOUBLE + {big * t(p0) ** n!r}::DOUBLE - {rho} * cos({turn})) / {z['unit']!r}::DOUBLE")


_LX, _LY = _lcc_sql()
LONLAT = """
SELECT c_custkey, -119.8 + CAST((c_custkey * 37) % 1010 AS DOUBLE) / 2000 AS lon,
       36.7 + CAST((c_custkey * 53) % 970 AS DOUBLE) / 2000 AS lat FROM customer"""


def _lonlat(spark, sf):
    return spark.sql(LONLAT.replace("FROM customer", "FROM {customer}"),
                     customer=table(spark, sf, "customer"))


@query("G13_project", with_views(f"SELECT c_custkey, {r(_LX, 'x', 3)}, {r(_LY, 'y', 3)} FROM ll",
                                 ll=LONLAT))
def g13(spark, sf):
    return rounded(sp.project(_lonlat(spark, sf)).select("c_custkey", "x", "y"), 3)


@query("G14_points_from_lonlat", with_views("""
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lon END AS x, lat AS y FROM ll""",
    ll=LONLAT))
def g14(spark, sf):
    df = _lonlat(spark, sf).withColumn(
        "lon", F.when(C("c_custkey") % 9 == 0, "?").otherwise(C("lon").cast("string")))
    return sp.points_from_lonlat(df, "lon", "lat").select("c_custkey", "x", "y")


@query("G15_edge_lengths", with_views(
    f"SELECT u, v, {r('length', 'euclidean')} FROM links", "links"))
def g15(spark, sf):
    net = network(spark, sf)
    return rounded(sp.edge_lengths(net.links, net.nodes))


@query("G15_trip_distances", with_views(f"""
SELECT t.l_orderkey, {r("sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))", "euclidean")}
FROM trip t JOIN nodes a ON a.node = t.o JOIN nodes b ON b.node = t.d""", "trip", "nodes"))
def g15_trips(spark, sf):
    # distances of the node pairs that occur, never of all pairs
    net = network(spark, sf)
    pairs = net.trip.select(C("o").alias("u"), C("d").alias("v"), "l_orderkey")
    return rounded(sp.edge_lengths(pairs, net.nodes, ("l_orderkey", "u", "v")).select(
        "l_orderkey", "euclidean"))


@query("K10_line_layer", with_views("""
SELECT u, v, printf('LINESTRING(%.6f %.6f, %.6f %.6f)', x1, y1, x2, y2) AS wkt FROM links""", "links"))
def k10(spark, sf):
    return sp.as_line_text(network(spark, sf).links).select("u", "v", "wkt")


@query("K10_point_layer", with_views(
    "SELECT c_custkey, printf('POINT(%.6f %.6f)', x, y) AS wkt FROM points", "points"))
def k10_points(spark, sf):
    return sp.as_point_text(view(spark, sf, "points")).select("c_custkey", "wkt")


@query("K10_congestion_layer", with_views("""
SELECT u, v, round(least(load / k, 1), 4) AS congestion,
       printf('LINESTRING(%.6f %.6f, %.6f %.6f)', x1, y1, x2, y2) AS wkt FROM links""", "links"))
def k10_congestion(spark, sf):
    from ..functions.scalars import congestion_index
    out = sp.as_line_text(network(spark, sf).links)
    return out.select("u", "v", congestion_index("load", "k").alias("congestion"), "wkt")
