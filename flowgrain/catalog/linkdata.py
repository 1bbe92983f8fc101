"""Link-table queries: matching, filters, features, imputation, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import joins as jn
from ..operators import reshape as rs
from ..operators import sampling as sm
from ..scale import ranked, salted_join
from .bindings import network, view, with_views
from .common import r, rounded
from .registry import query

C = F.col

# Views of this module ------------------------------------------------------------------

STATION_COUNTS = ("SELECT station_id, sum(flow_total) AS flow_total, "
                  + ", ".join(f"sum(flow_total_lane_{i}) AS flow_total_lane_{i}"
                              for i in range(1, 9))
                  + " FROM counts WHERE flow_total IS NOT NULL GROUP BY station_id")
# every station and segment of a feed belongs to one link: its rank modulo the number of links
LINK_PLACE = "SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS place FROM links"


def _place_sql(feed: str, key: str) -> str:
    return (f"SELECT {key} AS id, (row_number() OVER (ORDER BY {key}) - 1) % (SELECT count(*) FROM links) AS place "
            f"FROM (SELECT DISTINCT {key} FROM {feed})")


LINK_STATIONS = "SELECT u, v, id AS station_id FROM link_place JOIN station_place USING (place)"
STATIONS = {"link_place": LINK_PLACE, "station_place": _place_sql("counts", "station_id"), "ls": LINK_STATIONS}
SPEEDS = """
SELECT segment_id, max(speed) AS speed_max, avg(speed) AS speed_avg, stddev_samp(speed) AS speed_sd,
       avg(speed_ref) AS speed_ref_avg, stddev_samp(speed_ref) AS speed_ref_sd,
       avg(speed_hist) AS speed_hist_avg, stddev_samp(speed_hist) AS speed_hist_sd,
       stddev_samp(speed) / avg(speed_hist) AS cv, avg(travel_time) AS traveltime_avg,
       stddev_samp(travel_time) AS traveltime_sd, var_samp(travel_time) AS traveltime_var,
       max(road_closure_num) AS closed FROM dealt GROUP BY segment_id"""
SEGMENTS = {"link_place": LINK_PLACE, "segment_place": _place_sql("probe", "segment_id"),
            "dealt": "SELECT p.* REPLACE (s.place AS segment_id) FROM probe p JOIN segment_place s ON s.id = p.segment_id",
            "speeds": SPEEDS}
INCOME = "SELECT s_nationkey AS u, avg(s_acctbal) AS median_inc FROM supplier GROUP BY s_nationkey"
FX = """
SELECT l.*, coalesce(speed_avg, 0) AS speed_avg, coalesce(speed_sd, 0) AS speed_sd,
       coalesce(speed_ref_avg, 0) AS speed_ref_avg, coalesce(speed_hist_avg, 0) AS speed_hist_avg,
       coalesce(cv, 0) AS tt_cv, coalesce(traveltime_avg, 0) AS tt_avg, i.median_inc,
       (l.u * l.v) % 3 AS incidents, (l.u + 2 * l.v) % 4 AS bus_stops,
       (2 * l.u + l.v) % 3 AS intersections
FROM links l JOIN link_place k ON k.u = l.u AND k.v = l.v LEFT JOIN speeds ON segment_id = k.place
JOIN income i ON i.u = l.u"""


def fx_sql(text: str, **extra: str) -> str:
    return with_views(text, "links", "probe", **SEGMENTS, income=INCOME, fx=FX, **extra)


def link_places(links):
    """Links with their place in order of (u, v), and how many there are."""
    placed = ranked(links.select("u", "v"), [], [C("u"), C("v")], "place").withColumn("place", C("place") - 1)
    return placed, links.count()


def places(spark, sf, feed, key, n):
    """(key, place): the link that a station or segment of a feed belongs to."""
    ids = view(spark, sf, feed).select(key).distinct()
    return ranked(ids, [], [C(key)], "place").select(key, ((C("place") - 1) % n).alias("place"))


def link_stations(spark, sf):
    placed, n = link_places(network(spark, sf).links)
    return places(spark, sf, "counts0", "station_id", n).join(placed, "place").select("u", "v", "station_id")


def with_segment(links):
    placed, _ = link_places(links)
    return links.join(placed.withColumnRenamed("place", "segment_id"), ["u", "v"])


def speeds(spark, sf):
    """Statistics of the probe feed by link."""
    own = places(spark, sf, "probe", "segment_id", network(spark, sf).links.count())
    dealt = salted_join(view(spark, sf, "probe"), own, ["segment_id"], "inner")
    dealt = dealt.withColumn("segment_id", C("place")).drop("place")
    return agg.variation(agg.segment_statistics(dealt))


def fx(spark, sf):
    from .bindings import table
    net = network(spark, sf)
    out = jn.merge_probe(with_segment(net.links), speeds(spark, sf))
    inc = table(spark, sf, "supplier").groupBy(C("s_nationkey").alias("u")).agg(
        F.avg("s_acctbal").alias("median_inc"))
    return jn.attach(out, inc, ["u"]).withColumns({
        "incidents": C("u") * C("v") % 3, "bus_stops": (C("u") + 2 * C("v")) % 4,
        "intersections": (2 * C("u") + C("v")) % 3})


# joins ---------------------------------------------------------------------------------

@query("J01_merge_probe", with_views(
    "SELECT l.u, l.v, " + ", ".join([
        r(f"coalesce({src}, 0) * {f}", name) for name, src, f in (
            ("speed_max", "speed_max", 1), ("speed_avg", "speed_avg", 1),
            ("speed_sd", "speed_sd", 1), ("speed_ref_avg", "speed_ref_avg", 1),
            ("speed_ref_sd", "speed_ref_sd", 1), ("speed_hist_avg", "speed_hist_avg", 1),
            ("speed_hist_sd", "speed_hist_sd", 1), ("tt_cv", "cv", 1), ("speed_cv", "cv", 1),
            ("tt_avg", "traveltime_avg", 60), ("tt_sd", "traveltime_sd", 60),
            ("tt_var", "traveltime_var", 3600), ("road_closures", "CAST(closed AS DOUBLE)", 1))])
    + " FROM links l JOIN link_place k ON k.u = l.u AND k.v = l.v LEFT JOIN speeds ON segment_id = k.place",
    "links", "probe", **SEGMENTS))
def j01(spark, sf):
    out = jn.merge_probe(with_segment(network(spark, sf).links), speeds(spark, sf), "seconds")
    return rounded(out.select("u", "v", *jn.PROBE_TO_LINK))


@query("J02_remap_nodes", with_views("""
SELECT t.l_orderkey, a.key AS u, b.key AS v
FROM (SELECT l_orderkey, 1000 + 3 * o AS init_id, 1000 + 3 * d AS term_id FROM trip) t
JOIN ids a ON a.id = init_id JOIN ids b ON b.id = term_id""", "trip",
    ids="SELECT 1000 + 3 * n_nationkey AS id, 24 - n_nationkey AS key FROM nation"))
def j02(spark, sf):
    net = network(spark, sf)
    ids = net.nodes.select((1000 + 3 * C("node")).alias("id"), (24 - C("node")).alias("key"))
    trips = net.trip.select("l_orderkey", (1000 + 3 * C("o")).alias("init_id"),
                            (1000 + 3 * C("d")).alias("term_id"))
    return jn.remap_nodes(trips, ids).select("l_orderkey", "u", "v")


@query("J03_link_counts", with_views(f"""
SELECT l.u, l.v, {r("avg(c.flow_total) * 0.5", "count")}
FROM links l LEFT JOIN ls ON ls.u = l.u AND ls.v = l.v
LEFT JOIN sc c ON c.station_id = ls.station_id GROUP BY l.u, l.v""", "links", "counts",
    **STATIONS, sc=STATION_COUNTS))
def j03(spark, sf):
    counts = agg.station_counts(view(spark, sf, "counts"))
    return rounded(jn.link_counts(network(spark, sf).links, counts, factor=0.5, stations=link_stations(spark, sf)))


_OWN = "CASE 1 + (u + v) % 8 " + " ".join(f"WHEN {i} THEN flow_total_lane_{i}" for i in range(1, 9)) + " END"
_TOT = " + ".join(f"coalesce(flow_total_lane_{i}, 0)" for i in range(1, 9))
_HAVE = " + ".join(f"(CASE WHEN flow_total_lane_{i} IS NULL THEN 0 ELSE 1 END)"
                   for i in range(1, 9))


@query("J04_link_lane_counts", with_views(f"""
SELECT u, v, {r("coalesce(own, fallback)", "count")},
       CASE WHEN own IS NOT NULL THEN 1 ELSE 0 END AS matched,
       CASE WHEN own IS NULL AND seen > 0 THEN 1 ELSE 0 END AS imputed
FROM (SELECT l.u, l.v, avg({_OWN.replace("(u + v)", "(l.u + l.v)")}) AS own, count(c.station_id) AS seen,
             sum({_TOT}) / nullif(sum({_HAVE}), 0) AS fallback
      FROM links l LEFT JOIN ls ON ls.u = l.u AND ls.v = l.v
      LEFT JOIN sc c ON c.station_id = ls.station_id GROUP BY l.u, l.v)""", "links", "counts",
    **STATIONS, sc=STATION_COUNTS))
def j04(spark, sf):
    # five of eight lanes report, so some links have no value for their own lane
    links = network(spark, sf).links.withColumn("lane", 1 + (C("u") + C("v")) % 8)
    counts = agg.station_counts(view(spark, sf, "counts"))
    return rounded(jn.link_lane_counts(links, counts, stations=link_stations(spark, sf)))


@query("J05_attach_features", fx_sql(
    f"SELECT u, v, {r('median_inc', 'median_inc')}, {r('speed_avg', 'speed_avg')} FROM fx"))
def j05(spark, sf):
    feats = fx(spark, sf).select("u", "v", "median_inc", "speed_avg")
    return rounded(jn.attach(network(spark, sf).links.select("u", "v"), feats, strict=True))


@query("J06_set_bpr", with_views(
    "SELECT u, v, CAST(0.2 AS DOUBLE) AS alpha, CAST(3 AS DOUBLE) AS beta, tf + 1 AS tf, k, "
    "tf + 1 AS tt FROM links", "links"))
def j06(spark, sf):
    links = network(spark, sf).links
    bpr = links.select("u", "v", F.lit(0.2).alias("alpha"), F.lit(3.0).alias("beta"),
                       (C("tf") + 1).alias("tf"), "k")
    return jn.set_bpr(links, bpr).select("u", "v", "alpha", "beta", "tf", "k", "tt")


@query("J07_load_counts", with_views("""
SELECT l.u, l.v, n.c AS count FROM links l
LEFT JOIN (SELECT o, d, CAST(count(*) AS DOUBLE) AS c FROM trip GROUP BY o, d HAVING count(*) > 3) n
  ON n.o = l.u AND n.d = l.v""", "links", "trip"))
def j07(spark, sf):
    net = network(spark, sf)
    seen = net.od.where("q > 3").select(C("o").alias("u"), C("d").alias("v"), C("q").alias("count"))
    return jn.attach(net.links, seen).select("u", "v", "count")


@query("J08_merge_features", fx_sql(
    f"SELECT u, v, c, s, {r('speed_sd', 'speed_sd')} FROM fx"))
def j08(spark, sf):
    links = network(spark, sf).links
    feats = fx(spark, sf).select("u", "v", "speed_sd")
    return rounded(jn.merge_features(links.select("u", "v", "c"), links.select("u", "v", "s"),
                                     feats))


EST = """
SELECT l_returnflag || l_linestatus AS parameter, avg(l_discount) - CAST(0.05 AS DOUBLE) AS est,
       avg(l_tax) AS p_value FROM lineitem GROUP BY 1"""


def estimates(spark, sf):
    from .bindings import table
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("parameter")).agg(
        (F.avg("l_discount") - 0.05).alias("est"), F.avg("l_tax").alias("p_value"))


@query("J09_true_values", with_views(f"""
SELECT parameter, {r("est", "est")},
       CASE parameter WHEN 'AF' THEN CAST(0 AS DOUBLE) WHEN 'NO' THEN CAST(0.5 AS DOUBLE) END AS theta_true
FROM est""", est=EST))
def j09(spark, sf):
    out = jn.with_true_values(estimates(spark, sf), {"AF": 0.0, "NO": 0.5, "zz": 1.0})
    return rounded(out.select("parameter", "est", "theta_true"))


@query("J10_stations_by_id", with_views("""
SELECT u, v, array_to_string(list_filter([CAST(u * 25 + v AS VARCHAR),
       CASE WHEN (u + v) % 2 = 0 THEN CAST(u AS VARCHAR) ELSE 'none' END,
       CASE WHEN v % 3 = 0 THEN 'x' || CAST(v AS VARCHAR) END],
       lambda x: x IS NOT NULL AND regexp_full_match(x, '[0-9]+')), ',') AS ids FROM links""", "links"))
def j10(spark, sf):
    links = network(spark, sf).links
    layer = links.select(
        "u", "v", (C("u") * 25 + C("v")).cast("string").alias("id1"),
        F.when((C("u") + C("v")) % 2 == 0, C("u").cast("string")).otherwise("none").alias("id2"),
        F.when(C("v") % 3 == 0, F.concat(F.lit("x"), C("v").cast("string"))).alias("id3"))
    out = jn.match_stations_by_id(links, layer, ["id1", "id2", "id3"])
    return out.select("u", "v", F.array_join(F.transform("station_ids", lambda n: n.cast("string")),
                                             ",").alias("ids"))


@query("J15_copy_attributes", with_views(
    "SELECT u, v, tf * 2 AS tf, k + 1 AS k FROM links", "links"))
def j15(spark, sf):
    links = network(spark, sf).links
    other = links.select("u", "v", (C("tf") * 2).alias("tf"), (C("k") + 1).alias("k"))
    return jn.copy_attributes(links, other, ["tf", "k"]).select("u", "v", "tf", "k")


@query("J16_assemble_links", with_views(f"""
SELECT u, v, x1, y1, x2, y2, {r("length / lane", "tf")}, {r("k", "k")}, alpha, beta
FROM links""", "links"))
def j16(spark, sf):
    net = network(spark, sf)
    edges = net.links.select("u", "v", C("length").cast("string").alias("length"),
                             C("lane").cast("string").alias("ff_speed"),
                             C("k").cast("string").alias("capacity"))
    out = jn.assemble_links(edges, net.nodes)
    return rounded(out.select("u", "v", "x1", "y1", "x2", "y2", "tf", "k", "alpha", "beta"))


# filters -------------------------------------------------------------------------------

@query("P06_regular_links", with_views(
    "SELECT u, v, link_type FROM links WHERE link_type = 'LWRLK'", "links"))
def p06(spark, sf):
    return flt.regular_links(network(spark, sf).links).select("u", "v", "link_type")


@query("P06_connector_links", with_views(
    "SELECT u, v, link_type FROM links WHERE link_type <> 'LWRLK'", "links"))
def p06_connectors(spark, sf):
    return flt.connector_links(network(spark, sf).links).select("u", "v", "link_type")


@query("P07_observed_links", with_views(
    f"SELECT u, v, {r('count', 'count')} FROM links WHERE count IS NOT NULL", "links"))
def p07(spark, sf):
    return rounded(flt.observed_links(network(spark, sf).links).select("u", "v", "count"))


_BIG = "load > (SELECT avg(load) FROM links)"


@query("P08_clear_counts", with_views(
    f"SELECT u, v, {r(f'CASE WHEN {_BIG} THEN NULL ELSE count END', 'count')} FROM links", "links"))
def p08(spark, sf):
    from ..scale import scalar_join
    links = network(spark, sf).links
    keys = scalar_join(links, {"m": F.avg("load")}).where("load > m").select("u", "v")
    return rounded(flt.clear_counts(links, keys).select("u", "v", "count"))


@query("P09_mask_complement", with_views(
    f"SELECT u, v, {r(f'CASE WHEN {_BIG} THEN count END', 'count')} FROM links", "links"))
def p09(spark, sf):
    from ..scale import scalar_join
    links = network(spark, sf).links
    keys = scalar_join(links, {"m": F.avg("load")}).where("load > m").select("u", "v")
    return rounded(flt.clear_counts(links, keys, complement=True).select("u", "v", "count"))


_LONG = "SELECT u, v, count(*) AS n_paths FROM link_path WHERE n_links >= 5 GROUP BY u, v"


@query("P10_mask_uncovered", with_views(f"""
SELECT l.u, l.v, CAST(coalesce(n.n_paths, 0) AS BIGINT) AS n_paths,
       {r("CASE WHEN n.n_paths IS NULL THEN NULL ELSE l.count END", "count")}
FROM links l LEFT JOIN n ON n.u = l.u AND n.v = l.v""", "links", n=_LONG))
def p10(spark, sf):
    net = network(spark, sf)
    out = flt.mask_uncovered(net.links, net.paths.where(F.size("segs") >= 5))
    return rounded(out.select("u", "v", "n_paths", "count"))


@query("P12_nonzero_od", with_views(
    "SELECT o, d, q - 1 AS q FROM od WHERE q - 1 <> 0", "od"))
def p12(spark, sf):
    return flt.nonzero_od(network(spark, sf).od.withColumn("q", C("q") - 1)).select("o", "d", "q")


@query("P13_sign_consistent", with_views(f"""
SELECT parameter, {r("est", "est")} FROM est
WHERE (est > 0 AND parameter LIKE '%F') OR (est < 0 AND parameter NOT LIKE '%F')""", est=EST))
def p13(spark, sf):
    est = estimates(spark, sf)
    params = est.select("parameter", F.when(C("parameter").like("%F"), "+").otherwise("-")
                        .alias("sign"))
    return rounded(flt.sign_consistent(est, params).select("parameter", "est"))


@query("P14_select_features", with_views(
    "SELECT u, v, c, s, 'rain' AS missing FROM links", "links"))
def p14(spark, sf):
    df, missing = flt.select_features(network(spark, sf).links, ["c", "s", "rain"])
    return df.withColumn("missing", F.lit(",".join(missing)))


@query("P15_zero_connectors", with_views("""
SELECT u, v, CASE WHEN link_type = 'LWRLK' THEN c ELSE 0 END AS c,
       CASE WHEN link_type = 'LWRLK' THEN s ELSE 0 END AS s FROM links""", "links"))
def p15(spark, sf):
    return flt.zero_connectors(network(spark, sf).links, ["c", "s"]).select("u", "v", "c", "s")


@query("P16_in_box", with_views(
    "SELECT c_custkey, x, y FROM points WHERE x > 10 AND x < 60.5 AND y > 20 AND y < 80",
    "points"))
def p16(spark, sf):
    return view(spark, sf, "points").where(flt.in_box("x", "y", (10, 20, 60.5, 80)))


_IDS = """
SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN path_id ELSE
       CASE WHEN l_orderkey % 4 = 1 THEN concat_ws('-', CAST(o AS STRING), CAST(d AS STRING))
            WHEN l_orderkey % 4 = 2 THEN concat_ws('-', CAST(o AS STRING), CAST(d AS STRING), '0')
            ELSE concat_ws('-', CAST(o AS STRING), 'b') END END AS id FROM trip"""


@query("P17_valid_link_id", with_views("""
SELECT l_orderkey, l_orderkey % 4 IN (1, 2) AS valid FROM ids""", "trip", ids=_IDS))
def p17(spark, sf):
    df = spark.sql(_IDS.replace("FROM trip", "FROM {trip}"), trip=network(spark, sf).trip)
    return df.select("l_orderkey", flt.valid_link_id("id").alias("valid"))


# scalar functions on links -------------------------------------------------------------

@query("F01_bpr_time", with_views(
    f"SELECT u, v, {r('tf * (1 + alpha * pow(load / k, beta))', 'tt')} FROM links", "links"))
def f01(spark, sf):
    return rounded(network(spark, sf).links.select("u", "v", fn.bpr_time("load").alias("tt")))


_POW = "alpha / (beta + 1) * pow(load / k, beta) * load"


@query("F02_bpr_integral", with_views(
    f"SELECT u, v, {r(f'tf * (load + {_POW})', 'exact', 4)}, {r(f'tf * (1 + {_POW})', 'constant', 4)} "
    "FROM links", "links"))
def f02(spark, sf):
    return rounded(network(spark, sf).links.select(
        "u", "v", fn.bpr_integral("load").alias("exact"),
        fn.bpr_integral("load", constant_term=True).alias("constant")), 4)


@query("F03_entropy", with_views(
    f"SELECT path_id, {r('(trips - 1) * ln(trips - 1 + 1e-12)', 'entropy')} FROM path_trips",
    "path_trips"))
def f03(spark, sf):
    return rounded(network(spark, sf).paths.select(
        "path_id", fn.entropy(C("trips") - 1).alias("entropy")))


@query("F07_free_flow_time", with_views(f"""
SELECT u, v, {r("CASE WHEN (u + v) % 5 = 0 THEN tf ELSE 60 * length / ((u + v) % 5) END", "tf")}
FROM links""", "links"))
def f07(spark, sf):
    df = network(spark, sf).links.withColumn("speed", ((C("u") + C("v")) % 5).cast("double"))
    return rounded(df.select("u", "v", fn.free_flow_time("length", "speed", 60, "tf").alias("tf")))


@query("F08_capacity_divisor", with_views(f"""
SELECT u, v, CASE WHEN count IS NULL OR k - 20 <= 0 THEN NULL
                  ELSE greatest(1, ceil(count / (k - 20))) END AS factor,
       {r("CASE WHEN count IS NULL OR k - 20 <= 0 THEN NULL ELSE count / greatest(1, ceil(count / (k - 20))) END", "adjusted")}
FROM links""", "links"))
def f08(spark, sf):
    df = network(spark, sf).links.withColumn(
        "factor", fn.capacity_divisor("count", C("k") - 20))
    return rounded(df.select("u", "v", "factor", (C("count") / C("factor")).alias("adjusted")))


@query("F09_congestion_index", with_views(
    "SELECT u, v, round(least(load / k, 1), 4) AS congestion FROM links", "links"))
def f09(spark, sf):
    return network(spark, sf).links.select("u", "v",
                                           fn.congestion_index("load", "k").alias("congestion"))


@query("F10_shown_capacity", with_views(
    f"SELECT u, v, {r('CASE WHEN k * 150 > 10000 THEN 0 ELSE k * 150 END', 'capacity')}, k * 150 > 10000 AS open FROM links", "links"))
def f10(spark, sf):
    cap = fn.shown_capacity(C("k") * 150)
    open_ = cap == float("inf")
    return rounded(network(spark, sf).links.select(
        "u", "v", F.when(open_, 0.0).otherwise(cap).alias("capacity"), open_.alias("open")))


@query("F11_average_speed", with_views(
    "SELECT u, v, round(60 * length / tf, 1) AS speed FROM links", "links"))
def f11(spark, sf):
    return network(spark, sf).links.select("u", "v", fn.average_speed("length", "tf").alias("speed"))


_REG = "link_type = 'LWRLK'"


def _reg(expr: str) -> str:
    return f"CASE WHEN {_REG} THEN {expr} ELSE 0 END"


@query("F12_engineered_features", fx_sql("SELECT u, v, " + ", ".join([
    r(_reg("tf * tt_cv"), "tt_sd_adj", 4), r(_reg("length * speed_sd"), "speed_sd_length", 4),
    r(_reg("CASE WHEN speed_ref_avg <> 0 THEN speed_hist_avg / speed_ref_avg ELSE 0 END"),
      "speed_reliability", 4),
    r(_reg("CASE WHEN speed_ref_avg <> 0 THEN length / speed_avg ELSE tf END"), "tt_avg_adj", 4),
    r(_reg("length * median_inc"), "median_inc_length", 4),
    *[f"CAST({_reg(f'CASE WHEN {s} > 0 THEN 1 ELSE 0 END')} AS INTEGER) AS {y}, "
      f"CAST({_reg(f'CASE WHEN {s} > 0 THEN 0 ELSE 1 END')} AS INTEGER) AS {n}"
      for s, y, n in (("incidents", "incident", "no_incidents"),
                      ("bus_stops", "bus_stop", "no_bus_stops"),
                      ("intersections", "intersection", "no_intersections"))]]) + " FROM fx"))
def f12(spark, sf):
    out = fn.engineer_features(fx(spark, sf))
    return rounded(out.select("u", "v", "tt_sd_adj", "speed_sd_length", "speed_reliability",
                              "tt_avg_adj", "median_inc_length", "incident", "no_incidents",
                              "bus_stop", "no_bus_stops", "intersection", "no_intersections"), 4)


_FIXED = f"""
SELECT u, v, link_type, median_inc, tt_cv,
       CASE WHEN {_REG} AND speed_sd = 0 THEN (SELECT avg(speed_sd) FROM fx WHERE {_REG})
            ELSE speed_sd END AS speed_sd FROM fx"""
_CUTS = f"""
SELECT quantile_cont(median_inc, 0.25) AS q1, quantile_cont(tt_cv, 0.25) AS q2,
       quantile_cont(speed_sd, 0.25) AS q3 FROM fixed WHERE {_REG}"""


@query("F13_quartile_dummies", fx_sql("SELECT u, v, " + ", ".join(
    f"CAST({_reg(f'CASE WHEN {s} <= {q} THEN 1 ELSE 0 END')} AS INTEGER) AS {a}, "
    f"CAST({_reg(f'CASE WHEN {s} <= {q} THEN 0 ELSE 1 END')} AS INTEGER) AS {b}"
    for s, q, a, b in (("median_inc", "q1", "low_inc", "high_inc"),
                       ("tt_cv", "q2", "reliable_tt", "unreliable_tt"),
                       ("speed_sd", "q3", "reliable_speed", "unreliable_speed")))
    + " FROM fixed, cuts", fixed=_FIXED, cuts=_CUTS))
def f13(spark, sf):
    # equal averages of one nation must stay equal next to the percentile of them
    return fn.engineer_features(fx(spark, sf)).select(
        "u", "v", "low_inc", "high_inc", "reliable_tt", "unreliable_tt", "reliable_speed",
        "unreliable_speed")


@query("F14_as_number", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END
                          AS DOUBLE) AS k FROM events""")
def f14(spark, sf):
    from .bindings import table
    text = F.when(C("event_id") % 3 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", fn.as_number(text).alias("k"))


@query("F15_clean_text", """
SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS name,
       regexp_full_match(split_part(c_name, '#', 2), '[0-9]+') AS digits FROM customer""")
def f15(spark, sf):
    from .bindings import table
    return table(spark, sf, "customer").select(
        "c_custkey", fn.clean_text(F.concat(F.lit("  "), C("c_mktsegment"), F.lit(" "))).alias("name"),
        fn.is_digits(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("digits"))


@query("F16_link_label", with_views("""
SELECT u, v, '(' || u || ', ' || v || ', ''' || idx || ''')' AS key,
       '(' || (u + 1) || ', ' || (v + 1) || ')' AS shown FROM links""", "links"))
def f16(spark, sf):
    return network(spark, sf).links.select(
        "u", "v", fn.link_label("u", "v", "idx").alias("key"),
        fn.link_label("u", "v", shift=1).alias("shown"))


@query("F17_interval_label", with_views("""
SELECT u, v, printf('[%.3f, %.3f]', round(c - s, 3), round(c + s, 3)) AS ci FROM links""", "links"))
def f17(spark, sf):
    return network(spark, sf).links.select("u", "v", fn.interval_label("c", "s").alias("ci"))


@query("F18_value_of_time", with_views(
    f"SELECT u, v, {r('tf / nullif(c, 0)', 'vot')} FROM links", "links"))
def f18(spark, sf):
    return rounded(network(spark, sf).links.select("u", "v", fn.value_of_time("tf", "c").alias("vot")))


@query("F19_soft_threshold", with_views(f"""
SELECT u, v, {r("sign(c - s) * greatest(abs(c - s) - 0.25, 0)", "shrunk")} FROM links""", "links"))
def f19(spark, sf):
    return rounded(network(spark, sf).links.select(
        "u", "v", fn.soft_threshold(C("c") - C("s"), 0.25).alias("shrunk")))


@query("F20_almost_zero", with_views("""
SELECT u, v, CASE WHEN abs(c) < 0.35 THEN 0 ELSE c END AS zeroed,
       CASE WHEN abs(c) < 0.35 THEN 0.35::DOUBLE ELSE c END AS floored FROM links""", "links"))
def f20(spark, sf):
    return network(spark, sf).links.select(
        "u", "v", fn.almost_zero("c", 0.35).alias("zeroed"), fn.no_zeros("c", 0.35).alias("floored"))


@query("F21_nonnegative_weight", with_views(f"""
SELECT u, v, {r("-w + (SELECT abs(min(-w)) FROM ws)", "weight")} FROM ws""", "links",
    ws="SELECT u, v, s - 0.2 * tf AS w FROM links"))
def f21(spark, sf):
    df = network(spark, sf).links.withColumn("w", C("s") - 0.2 * C("tf"))
    return rounded(fn.nonnegative_weight(df, "w").select("u", "v", "weight"))


@query("V01_performance_slot", with_views(
    f"SELECT u, v, {r('tf + 0.5 * load / k', 'tt')} FROM links", "links"))
def v01(spark, sf):
    time = fn.performance(lambda x: C("tf") + 0.5 * C(x) / C("k"))
    return rounded(network(spark, sf).links.select("u", "v", time("load").alias("tt")))


@query("V05_row_functions", """
SELECT c_custkey, c_acctbal / 1000 AS balance_k, substr(c_name, 10) AS tail FROM customer""")
def v05(spark, sf):
    # per-row lambdas of a data frame are column expressions, never Python calls
    from .bindings import table
    return table(spark, sf, "customer").select(
        "c_custkey", (C("c_acctbal") / 1000).alias("balance_k"),
        F.substr(C("c_name"), F.lit(10)).alias("tail"))


# imputation and sampling ---------------------------------------------------------------

_CUT = (f"SELECT quantile_cont(length, 0.05) AS lo, quantile_cont(length, 0.9) AS hi FROM links "
        f"WHERE {_REG}")
_MID = f"SELECT avg(length) AS m FROM links, cut WHERE {_REG} AND length BETWEEN lo AND hi"


@query("I01_trim_impute", with_views(f"""
SELECT u, v, {r(f"CASE WHEN {_REG} AND (length < lo OR length > hi) THEN m ELSE length END", "length")}
FROM links, cut, mid""", "links", cut=_CUT, mid=_MID))
def i01(spark, sf):
    return rounded(sm.trim_impute(network(spark, sf).links, "length", 5, 90).select(
        "u", "v", "length"))


@query("I02_zero_to_mean", fx_sql("SELECT u, v, " + ", ".join(r(
    f"CASE WHEN {_REG} AND {f} = 0 THEN (SELECT avg({f}) FROM fx WHERE {_REG}) ELSE {f} END", f)
    for f in ("speed_sd", "speed_avg")) + " FROM fx"))
def i02(spark, sf):
    return rounded(sm.zero_to_mean(fx(spark, sf), ["speed_sd", "speed_avg"]).select(
        "u", "v", "speed_sd", "speed_avg"))


@query("I03_missing_to_mean", with_views(
    f"SELECT u, v, {r('coalesce(count, (SELECT avg(count) FROM links))', 'count')} FROM links",
    "links"))
def i03(spark, sf):
    return rounded(sm.missing_to_mean(network(spark, sf).links, ["count"]).select("u", "v", "count"))


@query("I04_fill_defaults", with_views(
    f"SELECT u, v, {r('coalesce(count, 0)', 'count')} FROM links", "links"))
def i04(spark, sf):
    return rounded(sm.fill_defaults(network(spark, sf).links, ["count"]).select("u", "v", "count"))


def _rank_sql(table: str, a: str, b: str, where: str = "") -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY h, {a}, {b}) AS pos, count(*) OVER () AS n "
            f"FROM (SELECT *, ((5 + CAST({a} AS BIGINT) * 31 + CAST({b} AS BIGINT) * 17) * 7919) "
            f"% 1000003 AS h FROM {table} {where})")


@query("I05_random_ods", with_views(
    "SELECT o, d, q FROM ranks WHERE pos <= floor(0.3 * n)", "od", ranks=_rank_sql("od", "o", "d")))
def i05(spark, sf):
    return sm.random_share(network(spark, sf).od, ["o", "d"], 0.3, 5, [31, 17]).select("o", "d", "q")


@query("I05_mask_by_coverage", with_views(f"""
SELECT u, v, {r("CASE WHEN pos > n - floor(n * 0.7) THEN count END", "count")},
       {r("CASE WHEN pos <= n - floor(n * 0.7) THEN count END", "withdrawn")} FROM ranks""", "links",
    ranks=_rank_sql("links", "u", "v")))
def i05_mask(spark, sf):
    out = sm.mask_by_coverage(network(spark, sf).links, ["u", "v"], 0.7, 5, [31, 17])
    return rounded(out.select("u", "v", "count", "withdrawn"))


@query("I06_split_counts", with_views("""
SELECT u, v, CASE WHEN pos <= floor(0.8 * n) THEN 'training' ELSE 'validation' END AS sample
FROM ranks""", "links", ranks=_rank_sql("links", "u", "v", "WHERE count IS NOT NULL")))
def i06(spark, sf):
    return sm.split_counts(network(spark, sf).links, ["u", "v"], 0.8, 5, [31, 17]).select(
        "u", "v", "sample")


@query("I07_noisy_counts")
def i07(spark, sf):
    return sm.noisy_counts(network(spark, sf).links, sd=0.1, seed=3).select("u", "v", "count")


@query("I08_noisy_demand")
def i08(spark, sf):
    od = network(spark, sf).od
    a = sm.noisy_demand(od, 0.1, 3).withColumnRenamed("q", "q_normal")
    b = sm.noisy_demand(od, "poisson", 3).withColumnRenamed("q", "q_poisson")
    return a.join(b, ["o", "d"])


@query("I09_random_features")
def i09(spark, sf):
    return sm.random_features(network(spark, sf).links, ["f1", "f2"], 0.0, 5.0, 3).select(
        "u", "v", "f1", "f2")


@query("I10_random_bpr", with_views("""
SELECT u, v, (1 + h % 5) / 5 AS tf, CAST(0.15 AS DOUBLE) AS alpha, CAST(4 AS DOUBLE) AS beta,
       CAST(1800 AS DOUBLE) AS k FROM ranks""", "links", ranks=_rank_sql("links", "u", "v")))
def i10(spark, sf):
    return sm.random_bpr(network(spark, sf).links, 5, weights=[31, 17]).select(
        "u", "v", "tf", "alpha", "beta", "k")


@query("I11_minibatch", with_views("""
SELECT u, v FROM ranks WHERE pos <= floor(0.25 * n)""", "links",
    ranks=_rank_sql("links", "u", "v", "WHERE count IS NOT NULL")))
def i11(spark, sf):
    seen = flt.observed_links(network(spark, sf).links)
    return sm.random_share(seen, ["u", "v"], 0.25, 5, [31, 17]).select("u", "v")


@query("T04_random_links", with_views("SELECT u, v FROM ranks ORDER BY pos LIMIT 20", "links",
                                      ranks=_rank_sql("links", "u", "v")))
def t04(spark, sf):
    return agg.random_links(network(spark, sf).links, 20, 5, ["u", "v"], [31, 17])


@query("U02_difference", with_views("""
SELECT o, d FROM od WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.u = od.o AND links.v = od.d
                                      AND links.load > 20)""", "od", "links"))
def u02(spark, sf):
    net = network(spark, sf)
    taken = net.links.where("load > 20").select(C("u").alias("o"), C("v").alias("d"))
    return rs.difference(net.od, taken, ["o", "d"]).select("o", "d")


@query("U03_shared_features", with_views(
    f"SELECT u, v, {r('-0.3 * tt - 0.5 * c', 'v_link')} FROM links", "links"))
def u03(spark, sf):
    links = network(spark, sf).links
    theta = fn.shared_features({"tt": -0.3, "c": -0.5, "rain": 9.0}, links)
    return rounded(links.select("u", "v", fn.linear_utility(theta).alias("v_link")))


@query("U04_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u04(spark, sf):
    from .bindings import table
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()
