"""File format queries: the tables are written in a format, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as nw
from ..sources import files as src
from ..sources import schemas as S
from ..sources import sinks as out
from .bindings import network, scratch, table, view, with_views
from .common import r, rounded
from .registry import query

C = F.col


def _as(df, schema, **values):
    """Columns of a file schema in order; those not given stay empty."""
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema])


# feeds ---------------------------------------------------------------------------------

_LANE_COLS = ", ".join(f"flow_total_lane_{i}" for i in range(1, 9))


@query("S01_read_counts", with_views(f"""
SELECT CAST(event_id AS INTEGER) AS samples, CAST(station_id AS INTEGER) AS station_id,
       date_trunc('second', ts) AS ts_casted, flow_total, {_LANE_COLS}
FROM counts WHERE hour(ts) * 60 + minute(ts) >= 360 AND hour(ts) * 60 + minute(ts) < 1080""", "counts"))
def s01(spark, sf):
    folder = scratch(spark, "counts")
    c = view(spark, sf, "counts")
    _as(c, S.COUNTS, ts=F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), station_id=C("station_id"),
        samples=C("event_id"), flow_total=C("flow_total"),
        **{f"flow_total_lane_{i}": C(f"flow_total_lane_{i}") for i in range(1, 9)}
        ).write.option("compression", "gzip").csv(folder)
    df = src.read_counts(spark, folder, 6, 720)
    return df.select("samples", "station_id", C("ts_casted").cast("timestamp_ntz").alias("ts_casted"),
                     "flow_total", *[f"flow_total_lane_{i}" for i in range(1, 9)])


@query("S02_read_probe", with_views(f"""
SELECT CAST(segment_id AS INTEGER) AS segment_id, CAST(event_id AS VARCHAR) AS name, dt,
       {r("speed * CAST(0.62137119223 AS DOUBLE)", "speed")},
       {r("speed_ref * CAST(0.62137119223 AS DOUBLE)", "speed_ref")}, road_closure_num,
       CAST(hour(ts) AS INTEGER) AS hour
FROM probe WHERE month(dt) = 1 AND dayofweek(dt) + 1 IN (2, 3, 4, 5, 6)""", "probe"))
def s02(spark, sf):
    folder = scratch(spark, "probe")
    p = view(spark, sf, "probe")
    _as(p, S.PROBE, dt=C("dt").cast("string"), segment_id=C("segment_id"), ts=C("ts").cast("string"),
        speed=C("speed"), speed_hist=C("speed_hist"), speed_ref=C("speed_ref"),
        travel_time=C("travel_time"), road_closure=C("road_closure"),
        name=C("event_id").cast("string")).write.option("header", True).csv(folder)
    df = src.read_probe(spark, folder, {"month": 1, "day_week": [2, 3, 4, 5, 6]})
    return rounded(df.select("segment_id", "name", "dt", "speed", "speed_ref", "road_closure_num",
                             "hour"))


@query("S03_read_incidents", """
SELECT CAST(event_id AS VARCHAR) AS Severity, CAST(hour(ts) AS INTEGER) AS hour, date_trunc('second', ts) AS start_ts
FROM events WHERE event_type = 'error' AND hour(ts) IN (7, 8, 16, 17)""")
def s03(spark, sf):
    folder = scratch(spark, "incidents")
    e = table(spark, sf, "events")
    start = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    e.select(C("event_id").alias("ID"), C("event_id").alias("Severity"), start.alias("Start_Time"),
             start.alias("End_Time"), F.lit(36.7).alias("Start_Lat"), F.lit(-119.8).alias("Start_Lng"),
             F.lit(36.7).alias("End_Lat"), F.lit(-119.8).alias("End_Lng"), C("props").alias("Description"),
             F.when(C("event_type") == "error", "Kern").otherwise(C("event_type")).alias("County")
             ).write.option("header", True).option("escape", '"').csv(folder)
    df = src.read_incidents(spark, folder, "Kern", {"hour": [7, 8, 16, 17]})
    return df.select("Severity", "hour", "start_ts")


@query("S04_read_stops", """
SELECT c_name AS stop_name, CAST(c_custkey AS VARCHAR) AS stop_id,
       CAST((c_custkey * 53) % 970 AS DOUBLE) / 10 AS stop_lat, c_acctbal AS stop_lon FROM customer""")
def s04(spark, sf):
    folder = scratch(spark, "stops")
    c = table(spark, sf, "customer")
    _as(c, S.STOPS, stop_id=C("c_custkey").cast("string"), stop_name=C("c_name"),
        stop_lat=((C("c_custkey") * 53) % 970).cast("double") / 10, stop_lon=C("c_acctbal")
        ).write.option("header", True).csv(folder)
    return src.read_stops(spark, folder).select("stop_name", "stop_id", "stop_lat", "stop_lon")


@query("S05_read_stations", """
SELECT CAST(s_suppkey AS INTEGER) AS station_id, s_acctbal AS lat, -s_acctbal AS lon
FROM supplier WHERE s_nationkey = 19""")
def s05(spark, sf):
    folder = scratch(spark, "stations")
    table(spark, sf, "supplier").select(
        C("s_suppkey").alias("ID"), C("s_name").alias("Name"), C("s_nationkey").alias("County"),
        C("s_acctbal").alias("Latitude"), (-C("s_acctbal")).alias("Longitude")
        ).write.option("header", True).option("sep", "\t").csv(folder)
    return src.read_stations(spark, folder, 19)


# network files -------------------------------------------------------------------------

_TNTP = {"capacity": "k", "length": "length", "free_flow_time": "tf", "b": "alpha", "power": "beta",
         "speed": "lane", "toll": "load"}


def _tntp_folder(spark, sf) -> str:
    """One folder per link type, as if each were a network; metadata lines included."""
    folder = scratch(spark, "tntp")
    links = network(spark, sf).links.withColumn("kind", F.lit(1))
    data = out.tntp_link_lines(links.withColumn("network", C("link_type")),
                               [*_TNTP.values(), "kind"], "network")
    head = data.select("network").distinct().select(
        "network", F.explode(F.array(
            F.lit("<NUMBER OF ZONES> 25\t"), F.lit("<END OF METADATA>\t\t"), F.lit(""),
            F.lit("~\tInit_node \tTerm_node \t capacity\tlength\tfree_flow_time\tb\tpower\tspeed\ttoll\tlink_type\t;")
        )).alias("value"))
    data.unionByName(head).write.partitionBy("network").text(folder)
    return folder


@query("S06_tntp_links", with_views(
    "SELECT link_type AS network, u AS init_node, v AS term_node, " + ", ".join(
        r(f"CAST({c} AS DOUBLE)", n) for n, c in _TNTP.items())
    + ", 1 AS link_type FROM links", "links"))
def s06(spark, sf):
    return rounded(src.read_tntp_links(spark, _tntp_folder(spark, sf)))


@query("S06_tntp_header", with_views("""
SELECT 'init_node,term_node,capacity,length,free_flow_time,b,power,speed,toll,link_type' AS names
FROM (SELECT count(*) AS n FROM links) WHERE n > 0""", "links"))
def s06_header(spark, sf):
    return src.read_tntp_header(spark, _tntp_folder(spark, sf)).select(
        F.array_join("names", ",").alias("names"))


@query("S07_tntp_trips", with_views("SELECT o, d, q FROM od", "od"))
def s07(spark, sf):
    folder = scratch(spark, "trips")
    out.tntp_trip_lines(network(spark, sf).od).write.text(folder)
    return src.read_tntp_trips(spark, folder)


@query("S08_tntp_network", with_views(f"""
SELECT u, v, idx, {r("tf", "free_flow_time")}, CAST(1 AS BIGINT) AS n FROM links""", "links"))
def s08(spark, sf):
    links, adj = src.read_tntp_network(spark, _tntp_folder(spark, sf))
    return rounded(links.join(adj, ["u", "v"]).select("u", "v", "idx", "free_flow_time", "n"))


def _city(spark, sf, variant: str):
    nodes, links = scratch(spark, "nodes"), scratch(spark, "links")
    net = network(spark, sf)
    ns, ls = (S.NODES, S.LINKS) if variant == "a" else (S.NODES_B, S.LINKS_B)
    tab = {"header": True, "sep": "\t"}
    _as(net.nodes, ns, id=1000 - 3 * C("node"), x=C("x"), y=C("y")).write.options(**tab).csv(nodes)
    _as(net.links, ls, id=C("u") * 25 + C("v"), link_type=C("link_type"),
        init_node_id=1000 - 3 * C("u"), term_node_id=1000 - 3 * C("v"),
        length=F.concat(F.lit(" "), C("length").cast("string")), ff_speed=F.lit("x"),
        capacity=C("k").cast("string"), lane=C("lane").cast("string")).write.options(**tab).csv(links)
    return src.read_city_network(spark, nodes, links, variant)


_CITY = with_views(f"""
SELECT CAST(u * 25 + v AS INTEGER) AS id, 24 - u AS u, 24 - v AS v, link_type, {r("length", "length")},
       {r("k", "capacity")}, CAST(lane AS DOUBLE) AS lane, CAST(NULL AS DOUBLE) AS ff_speed FROM links""", "links")


def _city_columns(links):
    return rounded(links.select("id", "u", "v", "link_type", "length", "capacity", "lane", "ff_speed"))


@query("S09_city_network", _CITY)
def s09(spark, sf):
    return _city_columns(_city(spark, sf, "a")[1])


@query("S10_city_network_b", _CITY)
def s10(spark, sf):
    return _city_columns(_city(spark, sf, "b")[1])


@query("S11_edge_network", with_views(
    f"SELECT 'e' || (u * 25 + v) AS link_id, 24 - u AS u, 24 - v AS v, {r('tf', 'tf')} FROM links",
    "links"))
def s11(spark, sf):
    net = network(spark, sf)
    edges, links, nodes = (scratch(spark, n) for n in ("edges", "attrs", "nodes"))
    lid = F.concat(F.lit("e"), (C("u") * 25 + C("v")).cast("string"))
    _as(net.links, S.EDGES_C, link_id=lid, init_node_id=1000 - 3 * C("u"),
        term_node_id=1000 - 3 * C("v")).write.option("header", True).csv(edges)
    net.links.select(lid.alias("link_id"), "tf").write.option("header", True).csv(links)
    _as(net.nodes, S.NODES_B, id=1000 - 3 * C("node"), x=C("x"), y=C("y")
        ).write.option("header", True).csv(nodes)
    _, got = src.read_edge_network(spark, edges, links, nodes)
    return rounded(got.select("link_id", "u", "v", C("tf").cast("double").alias("tf")))


@query("S11_wide_counts", """
SELECT CAST(user_id AS VARCHAR) AS link_id, replace(t, ':', '.') AS time_interval, max(CASE WHEN event_type = k THEN value END) AS count
FROM events, (VALUES ('07:00', 'click'), ('07:15', 'view'), ('07:30', 'error')) x(t, k)
GROUP BY user_id, t""")
def s11_counts(spark, sf):
    folder = scratch(spark, "wide")
    kinds = (("07:00", "click"), ("07:15", "view"), ("07:30", "error"))
    table(spark, sf, "events").groupBy(C("user_id").alias("link")).agg(*[
        F.max(F.when(C("event_type") == k, C("value"))).alias(t) for t, k in kinds]
        ).write.option("header", True).csv(folder)
    return src.read_wide_counts(spark, folder)


@query("S12_od_csv", with_views("SELECT 24 - o AS o, 24 - d AS d, q FROM od", "od"))
def s12(spark, sf):
    net = network(spark, sf)
    folder = scratch(spark, "od")
    rows = _as(net.od, S.OD_CSV, origin=1000 - 3 * C("o"), destination=1000 - 3 * C("d"), demand=C("q"))
    rows.withColumn("demand", C("demand") * 7).write.option("header", True).csv(f"{folder}/a")
    rows.write.option("header", True).csv(f"{folder}/b")
    keys = src.number_nodes(net.nodes.select((1000 - 3 * C("node")).alias("id")))
    return src.read_od_csv(spark, [f"{folder}/a", f"{folder}/b"], keys)


@query("S13_dynamic_od", with_views("SELECT o, d, q * (2 + 3 + 5) AS q FROM od", "od"))
def s13(spark, sf):
    folder = scratch(spark, "dynamic")
    steps = F.concat_ws(" ", *[(C("q") * i).cast("string") for i in range(1, 7)])
    network(spark, sf).od.select(F.concat(
        F.format_string("Origin: %d\nDest: %d\n  ", C("o"), C("d")), steps).alias("value")
        ).write.text(folder)
    return src.read_dynamic_od(spark, folder, [2, 3, 5])


@query("S14_read_paths", with_views("SELECT path_id, o, d FROM path_trips", "path_trips"))
def s14(spark, sf):
    folder = scratch(spark, "paths")
    out.write_paths(network(spark, sf).paths, folder)
    return src.read_paths(spark, folder).select("path_id", "o", "d")


@query("S15_read_paths_remapped", with_views(
    "SELECT 24 - o AS o, 24 - d AS d, CAST(count(*) AS BIGINT) AS n FROM path_trips GROUP BY o, d",
    "path_trips"))
def s15(spark, sf):
    net = network(spark, sf)
    folder = scratch(spark, "paths")
    shifted = net.paths.select(F.transform("nodes", lambda n: 1000 - 3 * n).alias("nodes"))
    out.write_paths(shifted, folder, " ")
    keys = src.number_nodes(net.nodes.select((1000 - 3 * C("node")).alias("id")))
    got = src.read_paths(spark, folder, " ", keys)
    return got.groupBy("o", "d").agg(F.count(F.lit(1)).alias("n"))


@query("S16_dense_matrix", with_views("SELECT o AS row, d AS col, q AS value FROM od", "od"))
def s16(spark, sf):
    from ..operators.reshape import od_matrix
    folder = scratch(spark, "matrix")
    net = network(spark, sf)
    n = net.nodes.agg(F.max("node")).first()[0] + 1
    # rows and columns of the file are node numbers, so that nodes without trips have a line too
    wide = net.nodes.select(C("node").alias("o")).join(od_matrix(net.od, range(n)), "o", "left").na.fill(0.0).orderBy("o")
    wide.select(F.concat_ws(",", *[C(f"d{j}").cast("string") for j in range(n)])).write.text(folder)
    return src.read_dense_matrix(spark, folder)


@query("S21_read_network", with_views("""
SELECT 'links' AS name, count(*) AS n FROM links UNION ALL SELECT 'od', count(*) FROM od
UNION ALL SELECT 'paths', count(*) FROM path_trips""", "links", "od", "path_trips"))
def s21(spark, sf):
    net = network(spark, sf)
    folder = scratch(spark, "network")
    tables = {"links": net.links, "od": net.od, "paths": net.paths}
    out.write_network(tables, folder)
    got = src.read_network(spark, folder, list(tables))
    rows = None
    for name, df in got.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("K07_incidence_by_network", with_views(
    "SELECT k.path_id, k.u, k.v, CAST(k.seq AS INTEGER) - 0 AS seq, l.link_type AS network FROM link_path k JOIN links l USING (u, v)",
    "links", "link_path"))
def k07(spark, sf):
    net = network(spark, sf)
    folder = scratch(spark, "incidence")
    hops = nw.hop_rows(net.paths).join(net.links.select("u", "v", C("link_type").alias("network")),
                                       ["u", "v"])
    out.write_network({"link_path": hops}, folder, by="network")
    return src.read_network(spark, folder, ["link_path"])["link_path"].select(
        "path_id", "u", "v", "seq", "network")


@query("K11_write_network", with_views("SELECT o, d, q FROM od", "od"))
def k11(spark, sf):
    folder = scratch(spark, "network")
    od = network(spark, sf).od
    out.write_network({"od": od.withColumn("q", C("q") * 2)}, folder)
    out.write_network({"od": od}, folder)
    return src.read_network(spark, folder, ["od"])["od"]


# layers --------------------------------------------------------------------------------

_GEO = """
SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '06019' ELSE '06031' END || '00' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS GEOID,
       c_custkey, c_acctbal FROM customer"""


@query("S17_census_blocks", f"""
SELECT GEOID, c_acctbal AS median_inc, c_custkey % 90 AS median_age FROM ({_GEO})
WHERE substr(GEOID, 1, 5) = '06019' AND c_acctbal > 0""")
def s17(spark, sf):
    c = table(spark, sf, "customer")
    geoid = F.concat(F.when(C("c_mktsegment") == "BUILDING", "06019").otherwise("06031"), F.lit("00"),
                     F.lpad(C("c_custkey").cast("string"), 9, "0"))
    geo = c.select(geoid.alias("GEOID"))
    inc = c.where("c_acctbal > 0").select(geoid.alias("GEOID"), C("c_acctbal").alias("median_inc"))
    age = c.select(geoid.alias("GEOID"), (C("c_custkey") % 90).alias("median_age"))
    return src.census_blocks(geo, inc, age, "06019")


@query("S18_county_segments", """
SELECT o_orderkey AS segment_id, o_orderpriority AS County FROM orders WHERE o_orderpriority = '1-URGENT'""")
def s18(spark, sf):
    seg = table(spark, sf, "orders").select(C("o_orderkey").alias("segment_id"),
                                            C("o_orderpriority").alias("County"))
    return src.county_segments(seg, "1-URGENT")


@query("S19_read_layer", with_views(
    f"SELECT u, v, {r('x1', 'x1')}, {r('y1', 'y1')}, {r('x2', 'x2')}, {r('y2', 'y2')} FROM links", "links"))
def s19(spark, sf):
    from ..operators.spatial import as_line_text
    folder = scratch(spark, "layer")
    as_line_text(network(spark, sf).links).select("u", "v", "wkt").write.parquet(folder)
    return rounded(src.read_layer(spark, folder))


@query("S20_link_table", with_views(f"SELECT u, v, idx, {r('count', 'count', 3)} FROM links", "links"))
def s20(spark, sf):
    from ..functions.scalars import link_label
    folder = scratch(spark, "linktable")
    network(spark, sf).links.select(link_label("u", "v", "idx").alias("link_key"), "count"
                                    ).write.option("header", True).csv(folder)
    return rounded(src.read_link_table(spark, folder, ["count"]), 3)


# sinks ---------------------------------------------------------------------------------

@query("K01_write_days", with_views("SELECT event_id, segment_id, dt FROM probe", "probe"))
def k01(spark, sf):
    folder = scratch(spark, "days")
    out.write_days(view(spark, sf, "probe").select("event_id", "segment_id", "dt", "speed"), folder)
    return spark.read.parquet(folder).select("event_id", "segment_id", "dt")


@query("K02_write_years", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def k02(spark, sf):
    folder = scratch(spark, "years")
    out.write_years(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), folder,
                    "o_orderdate")
    return spark.read.parquet(folder).select("o_orderkey", "year")


@query("K03_write_table", with_views("""
SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, link_type, printf('%.3f', length) AS length FROM links""", "links"))
def k03(spark, sf):
    folder = scratch(spark, "table")
    out.write_table(network(spark, sf).links.select("u", "v", "link_type", "length"), folder)
    return spark.read.option("header", True).csv(folder)


@query("K04_report", with_views("""
SELECT 'method' AS option, 'lm' AS value UNION ALL SELECT 'iters', '10' UNION ALL
SELECT 'links', CAST(count(*) AS VARCHAR) FROM links UNION ALL
SELECT 'paths', CAST(count(*) AS VARCHAR) FROM path_trips UNION ALL
SELECT 'ods', CAST(count(*) AS VARCHAR) FROM od""", "links", "path_trips", "od"))
def k04(spark, sf):
    net = network(spark, sf)
    return out.report(spark, {"method": "lm", "iters": 10}, links=net.links, paths=net.paths,
                      ods=net.od)


@query("K12_replicates", "SELECT l_returnflag AS flag, rep, count(*) AS n FROM lineitem, "
       "(VALUES (1), (2)) t(rep) GROUP BY l_returnflag, rep")
def k12(spark, sf):
    folder = scratch(spark, "replicates")
    n = table(spark, sf, "lineitem").groupBy(C("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"))
    for rep in (1, 2, 3):
        out.write_replicate(n, folder, rep)
    return out.cumulative_replicates(spark, folder, 2).select("flag", "rep", "n")


@query("K06_write_paths", with_views(
    "SELECT replace(path_id, '/', ',') AS value FROM path_trips", "path_trips"))
def k06(spark, sf):
    folder = scratch(spark, "paths")
    out.write_paths(network(spark, sf).paths, folder)
    return spark.read.text(folder)


@query("K08_write_demand_dat", with_views(
    "SELECT o + 1 AS origin, d + 1 AS dest, q AS demand FROM od WHERE o <> d", "od"))
def k08(spark, sf):
    folder = scratch(spark, "demand")
    out.write_dat(out.demand_rows(network(spark, sf).od), folder)
    return spark.read.option("header", True).option("sep", "\t").schema(
        "origin int, dest int, demand double").csv(folder)


@query("K08_write_network_dat", with_views(f"""
SELECT u + 1 AS origin, v + 1 AS dest, {r("k", "capacity")}, tf AS length, tf AS fft, alpha, beta,
       0 AS "speedLimit" FROM links""", "links"))
def k08_network(spark, sf):
    folder = scratch(spark, "netdat")
    out.write_dat(out.link_rows(network(spark, sf).links), folder)
    df = spark.read.option("header", True).option("sep", "\t").schema(
        "origin int, dest int, capacity double, length double, fft double, alpha double, "
        "beta double, speedLimit int").csv(folder)
    return rounded(df, length=-1, fft=-1, alpha=-1, beta=-1)


@query("K09_feature_layer", with_views(f"""
SELECT u, v, c, s, printf('LINESTRING(%.6f %.6f, %.6f %.6f)', x1, y1, x2, y2) AS wkt FROM links""",
    "links"))
def k09(spark, sf):
    links = network(spark, sf).links
    return out.feature_layer(links, links.select("u", "v", "c", "s"))
