"""Feeds and a road network derived from the driver's test tables.

Orders are trips: the nations of an order's suppliers, in the order of their first line, are
the nodes of its path. Distinct node sequences are the path table, their counts the demand, their
neighbouring nodes the links. Events are detector and probe readings. All of it grows
with the tables. ``SQL`` holds each view as text for DuckDB; Spark runs the same text
where the dialects agree.
"""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import paths_from_nodes
from ..session import shared_dir, store, utc

C = F.col
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_LANES = ", ".join(f"CASE WHEN lane = {i} THEN flow_total END AS flow_total_lane_{i}"
                   for i in range(1, 9))

SQL: dict[str, str] = {}

SQL["counts0"] = """
SELECT event_id, user_id AS station_id, ts,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                       WHEN 'error' THEN 4 ELSE 5 END AS lane,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS flow_total
FROM events"""
SQL["counts"] = f"SELECT event_id, station_id, ts, lane, flow_total, {_LANES} FROM counts0"

SQL["probe"] = """
SELECT event_id, user_id AS segment_id, CAST(ts AS DATE) AS dt, ts, value AS speed,
       value * 0.9 + 5 AS speed_hist, value * 0.5 + 40 AS speed_ref,
       60 / (value + 1) AS travel_time,
       CASE WHEN event_type = 'error' THEN 'T' ELSE 'F' END AS road_closure,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS road_closure_num
FROM events"""

SQL["nodes"] = """
SELECT n_nationkey AS node, CAST((n_nationkey * 37) % 101 AS DOUBLE) AS x,
       CAST((n_nationkey * 53) % 97 AS DOUBLE) AS y
FROM nation"""

# the nations of an order in the order of their first line; of one line, the smaller first
SQL["stop"] = """
SELECT l_orderkey, s_nationkey AS node, min(l_linenumber) AS line
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY l_orderkey, s_nationkey"""

# DuckDB only: Spark keeps the stops of an order as an array.
SQL["trip"] = """
SELECT l_orderkey, string_agg(CAST(node AS VARCHAR), '/' ORDER BY line, node) AS path_id,
       arg_min(node, line * 1000000 + node) AS o, arg_max(node, line * 1000000 + node) AS d
FROM stop GROUP BY l_orderkey HAVING count(*) >= 2"""

SQL["path_trips"] = """
SELECT path_id, o, d, CAST(count(*) AS DOUBLE) AS trips FROM trip GROUP BY path_id, o, d"""

SQL["od"] = "SELECT o, d, CAST(count(*) AS DOUBLE) AS q FROM trip GROUP BY o, d"

# DuckDB only: Spark builds the same rows from the node arrays.
SQL["link_path"] = """
SELECT path_id, o, d, trips, i - 1 AS seq, CAST(parts[i] AS INTEGER) AS u,
       CAST(parts[i + 1] AS INTEGER) AS v, len(parts) - 1 AS n_links
FROM (SELECT path_id, o, d, trips, parts, unnest(range(1, len(parts))) AS i
      FROM (SELECT *, string_split(path_id, '/') AS parts FROM path_trips))"""

SQL["link_load"] = "SELECT u, v, sum(trips) AS load, count(*) AS n_paths FROM link_path GROUP BY u, v"

SQL["links0"] = """
SELECT u, v, '0' AS idx, load, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
       sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length,
       1 + (u + v) % 5 AS lane,
       CASE WHEN (u * v) % 11 = 0 THEN 'CONN' ELSE 'LWRLK' END AS link_type,
       CAST(1 + (u * 7 + v * 3) % 10 AS DOUBLE) AS tf,
       5 + load * (60 + 10 * ((u * 11 + v * 5) % 8)) / 100 AS k,
       CAST(0.15 AS DOUBLE) AS alpha, CAST(4 AS DOUBLE) AS beta,
       CAST((u * 13 + v * 29) % 17 AS DOUBLE) / 10 AS c,
       CAST((u * 5 + v * 3) % 7 AS DOUBLE) / 10 AS s,
       CASE WHEN (u + v) % 4 = 0 THEN NULL
            ELSE load * (80 + 5 * ((u * 31 + v * 17) % 9)) / 100 END AS count
FROM link_load JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v"""
SQL["links"] = "SELECT *, tf AS tt FROM links0"

# A point per event and per customer on the node plane.
SQL["incidents"] = """
SELECT event_id, ts, event_type, CAST((event_id * 37) % 1010 AS DOUBLE) / 10 AS x,
       CAST((event_id * 53) % 970 AS DOUBLE) / 10 AS y
FROM events"""
SQL["points"] = """
SELECT c_custkey, CAST((c_custkey * 37) % 1010 AS DOUBLE) / 10 AS x,
       CAST((c_custkey * 53) % 970 AS DOUBLE) / 10 AS y
FROM customer"""
SQL["stations"] = """
SELECT s_suppkey AS station_id, CAST((s_suppkey * 61) % 1009 AS DOUBLE) / 10 + 0.03 AS x,
       CAST((s_suppkey * 29) % 967 AS DOUBLE) / 10 + 0.07 AS y
FROM supplier"""

NEEDS = {"counts": ["counts0"], "trip": ["stop"], "path_trips": ["trip"], "od": ["trip"],
         "link_path": ["path_trips"], "link_load": ["link_path"],
         "links0": ["link_load", "nodes"], "links": ["links0"]}


def with_views(query: str, *views: str, **extra: str) -> str:
    """DuckDB text: the named views (and what they need) as CTEs, then ``query``."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in done:
            done.append(name)

    for v in views:
        add(v)
    ctes = [f"{n} AS ({SQL[n]}\n)" for n in done] + [f"{n} AS ({t})" for n, t in extra.items()]
    return f"WITH {', '.join(ctes)}\n{query}" if ctes else query


# Spark ---------------------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A feed or point view, by the shared text over the tables it names."""
    utc(spark)
    text = SQL[name]
    args = {}
    for dep in [*NEEDS.get(name, []), *TABLES]:
        if f" {dep}" in text.replace("\n", " ") and (f"FROM {dep}" in text or f"JOIN {dep}" in text):
            args[dep] = view(spark, sf, dep) if dep in SQL else table(spark, sf, dep)
    for dep in args:
        text = text.replace(f"FROM {dep}", f"FROM {{{dep}}}").replace(
            f"JOIN {dep}", f"JOIN {{{dep}}}")
    return spark.sql(text, **args)


def _trips(stop: DataFrame) -> DataFrame:
    """(l_orderkey, path_id, o, d): orders that touch at least two nations."""
    each = F.sort_array(F.collect_list(F.struct("line", "node")))["node"]
    seen = stop.groupBy("l_orderkey").agg(each.alias("nodes")).where(F.size("nodes") >= 2)
    return seen.select("l_orderkey", F.array_join(C("nodes").cast("array<string>"), "/").alias("path_id"),
                       F.element_at("nodes", 1).alias("o"), F.element_at("nodes", -1).alias("d"))


_NETWORKS: dict[tuple[str, str], SimpleNamespace] = {}


def network(spark: SparkSession, sf: str) -> SimpleNamespace:
    """Path, demand and link tables, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _NETWORKS:
        return _NETWORKS[key]
    trip = store(_trips(view(spark, sf, "stop")))
    trips = trip.groupBy("path_id", "o", "d").agg(F.count(F.lit(1)).cast("double").alias("trips"))
    nodes = F.transform(F.split("path_id", "/"), lambda n: n.cast("int"))
    paths = paths_from_nodes(trips.select(nodes.alias("nodes")))
    paths = store(paths.join(trips.select("path_id", "trips"), "path_id"))
    od = store(trip.groupBy("o", "d").agg(F.count(F.lit(1)).cast("double").alias("q")))
    seg = paths.select(F.explode("segs").alias("g"), "trips").select("g.u", "g.v", "trips")
    load = seg.groupBy("u", "v").agg(F.sum("trips").alias("load"),
                                     F.count(F.lit(1)).alias("n_paths"))
    node = view(spark, sf, "nodes")
    text = SQL["links0"].replace("FROM link_load", "FROM {link_load}").replace(
        "JOIN nodes", "JOIN {nodes}")
    links = store(spark.sql(text, link_load=load, nodes=node).withColumn("tt", C("tf")))
    _NETWORKS[key] = SimpleNamespace(trip=trip, paths=paths, od=od, links=links, nodes=node)
    return _NETWORKS[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for files a query writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

