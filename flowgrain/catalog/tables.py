"""Aggregation, ordering and report-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import reshape as rs
from .bindings import network, table, view, with_views
from .common import r, rounded
from .linkdata import fx, fx_sql
from .registry import query

C = F.col


@query("A06_type_frequencies", with_views(f"""
SELECT link_type, count(*) AS n, {r("count(*) / (SELECT count(*) FROM links)", "share")}
FROM links GROUP BY link_type""", "links"))
def a06(spark, sf):
    return rounded(agg.type_frequencies(network(spark, sf).links))


# the trips of each order status form a network of their own
_STATUS = "trip t JOIN orders ON o_orderkey = t.l_orderkey"


@query("A07_network_summary", with_views(f"""
SELECT network, (SELECT count(DISTINCT n) FROM (SELECT network AS w, o AS n FROM s UNION ALL SELECT network, d FROM s) x
                 WHERE x.w = s.network) AS nodes,
       count(DISTINCT (o, d)) AS links, count(DISTINCT (o, d)) AS ods, count(DISTINCT path_id) AS paths
FROM s GROUP BY network""", "trip", s=f"SELECT o_orderstatus AS network, t.* FROM {_STATUS}"))
def a07(spark, sf):
    trip = network(spark, sf).trip
    status = table(spark, sf, "orders").select(C("o_orderkey").alias("l_orderkey"),
                                               C("o_orderstatus").alias("network"))
    s = trip.join(status, "l_orderkey")
    links = s.select("network", C("o").alias("u"), C("d").alias("v")).distinct()
    od = s.groupBy("network", "o", "d").agg(F.count(F.lit(1)).alias("q"))
    return agg.network_summary(links, od, s.select("network", "path_id").distinct())


def _describe(f: str) -> str:
    return (f"SELECT '{f}' AS feature, count({f}) AS n, {r(f'avg({f})', 'mean')}, "
            f"{r(f'stddev_samp({f})', 'std')}, {r(f'min({f})', 'min')}, "
            + ", ".join(r(f"quantile_cont({f}, {q})", n) for q, n in (
                (0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
            + f", {r(f'max({f})', 'max')} FROM probe")


@query("A08_describe", with_views(
    " UNION ALL ".join(_describe(f) for f in ("speed", "speed_ref", "travel_time")), "probe"))
def a08(spark, sf):
    return rounded(agg.describe(view(spark, sf, "probe"), ["speed", "speed_ref", "travel_time"]))


@query("A09_link_coverage", with_views(f"""
SELECT count(*) AS n_links, count(l.count) AS n_observed,
       count(CASE WHEN n.n_paths IS NOT NULL THEN l.count END) AS n_covered,
       {r("count(l.count) / count(*)", "coverage")},
       {r("count(CASE WHEN n.n_paths IS NOT NULL THEN l.count END) / count(*)", "adjusted_coverage")}
FROM links l LEFT JOIN n ON n.u = l.u AND n.v = l.v""", "links",
    n="SELECT u, v, count(*) AS n_paths FROM link_path WHERE n_links >= 5 GROUP BY u, v"))
def a09(spark, sf):
    net = network(spark, sf)
    return rounded(agg.link_coverage(net.links, net.paths.where(F.size("segs") >= 5)))


@query("A10_demand_totals", with_views(
    f"SELECT {r('sum(q) * 1.5::DOUBLE', 'trips')}, count(*) AS ods FROM od WHERE q <> 0", "od"))
def a10(spark, sf):
    return rounded(agg.demand_totals(network(spark, sf).od, 1.5))


@query("A11_saturation", with_views(f"""
SELECT count(*) AS n, {r("avg(count / k)", "mean_ratio")}, {r("max(count / k)", "max_ratio")},
       CAST(sum(CASE WHEN count / k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_over,
       {r("avg(CASE WHEN count / k > 1 THEN 1.0 ELSE 0.0 END)", "share_over")}
FROM links WHERE count IS NOT NULL""", "links"))
def a11(spark, sf):
    return rounded(agg.saturation(network(spark, sf).links))


@query("A12_path_sums", with_views(f"""
SELECT p.path_id, {r("sum(l.tt)", "tt")}, {r("sum(l.c)", "c")}, {r("sum(l.s)", "s")}
FROM link_path p JOIN links l ON l.u = p.u AND l.v = p.v GROUP BY p.path_id""", "links"))
def a12(spark, sf):
    from ..plans.choice import path_sums
    net = network(spark, sf)
    return rounded(path_sums(net.paths, net.links, ["tt", "c", "s"]).select(
        "path_id", "tt", "c", "s"))


@query("A13_link_flows", with_views(
    f"SELECT u, v, {r('sum(trips)', 'x')} FROM link_path GROUP BY u, v", "link_path"))
def a13(spark, sf):
    from ..plans.choice import link_flows
    net = network(spark, sf)
    return rounded(link_flows(net.paths, net.links, flow="trips").select("u", "v", "x"))


@query("A14_paths_per_link", with_views(
    "SELECT u, v, count(*) AS n_paths FROM link_path GROUP BY u, v", "link_path"))
def a14(spark, sf):
    from ..operators.filters import paths_per_link
    return paths_per_link(network(spark, sf).paths).select("u", "v", "n_paths")


@query("A14_links_per_path", with_views(
    "SELECT path_id, CAST(count(*) AS INTEGER) AS n_links FROM link_path GROUP BY path_id",
    "link_path"))
def a14_links(spark, sf):
    return agg.links_per_path(network(spark, sf).paths)


@query("A15_choice_set_sums", with_views(
    "SELECT o, d, sum(trips) AS total FROM path_trips GROUP BY o, d", "path_trips"))
def a15(spark, sf):
    return agg.choice_set_sums(network(spark, sf).paths, "trips")


_PAIRS = [("length", "tf"), ("length", "c"), ("length", "speed_sd"), ("tf", "c"),
          ("tf", "speed_sd"), ("c", "speed_sd")]


@query("A16_correlations", fx_sql(" UNION ALL ".join(
    f"SELECT link_type, '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM fx GROUP BY link_type"
    for a, b in _PAIRS)))
def a16(spark, sf):
    return rounded(agg.correlations(fx(spark, sf), ["length", "tf", "c", "speed_sd"], ["link_type"]))


@query("A17_error_histogram", f"""
SELECT floor((l_extendedprice - 900 * l_quantity) / 500) * 500 AS bin, count(*) AS n,
       {r("count(*) * 100.0 / (SELECT count(*) FROM lineitem)", "percent")}
FROM lineitem GROUP BY 1""")
def a17(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("err", C("l_extendedprice") - 900 * C("l_quantity"))
    return rounded(agg.error_histogram(li))


RESULTS = """
SELECT l_shipdate AS day, l_returnflag AS method, l_linenumber AS level,
       l_discount - 0.05 AS est, l_tax AS p_value, l_quantity / 50 AS nrmse,
       l_extendedprice / 1000 AS time, l_orderkey, l_partkey,
       CASE WHEN l_linestatus = 'F' THEN 'tt' ELSE 'c' END AS parameter
FROM lineitem"""


def results(spark, sf):
    return spark.sql(RESULTS.replace("FROM lineitem", "FROM {lineitem}"),
                     lineitem=table(spark, sf, "lineitem"))


_FLAGS = """
SELECT *, est - theta_true AS bias, CASE WHEN theta_true = 0 THEN 'fp' ELSE 'fn' END AS f_type,
       CASE WHEN theta_true = 0 AND p_value < 0.05 THEN 1 ELSE 0 END AS fp,
       CASE WHEN theta_true <> 0 AND p_value > 0.05 THEN 1 ELSE 0 END AS fn
FROM (SELECT *, CASE parameter WHEN 'tt' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS theta_true FROM res)"""


@query("R11_test_flags", with_views(f"""
SELECT l_orderkey, l_partkey, parameter, f_type, fp, fn, {r("bias", "bias")}, theta_true
FROM flags""", res=RESULTS, flags=_FLAGS))
def r11(spark, sf):
    return rounded(_flags(spark, sf).select("l_orderkey", "l_partkey", "parameter", "f_type", "fp", "fn",
                                            "bias", "theta_true"))


def _flags(spark, sf):
    return rs.test_flags(results(spark, sf), {"tt": -1.0, "c": 0.0})


@query("A18_experiment_summary", with_views(f"""
SELECT method, level, count(*) AS n, {r("avg(fp)", "fp_share")}, {r("avg(fn)", "fn_share")},
       {r("avg(nrmse)", "nrmse_avg")}, {r("avg(time)", "time_avg")},
       {r("quantile_cont(bias, 0.25)", "bias_p25")}, {r("quantile_cont(bias, 0.5)", "bias_p50")},
       {r("quantile_cont(bias, 0.75)", "bias_p75")}
FROM flags GROUP BY method, level""", res=RESULTS, flags=_FLAGS))
def a18(spark, sf):
    return rounded(agg.experiment_summary(_flags(spark, sf), ["method", "level"]))


@query("A19_mean_count_benchmark", with_views(f"""
SELECT {r("avg(count)", "mean_count")}, {r("sum(pow(count - (SELECT avg(count) FROM links), 2))", "sse", 3)}
FROM links WHERE count IS NOT NULL""", "links"))
def a19(spark, sf):
    return rounded(agg.mean_count_benchmark(network(spark, sf).links), sse=3)


@query("A20_scale_min_max", with_views("SELECT event_id, " + ", ".join(
    r(f"({f} - (SELECT min({f}) FROM probe)) / (SELECT max({f}) - min({f}) FROM probe)", f)
    for f in ("speed", "travel_time")) + " FROM probe", "probe"))
def a20(spark, sf):
    return rounded(agg.scale_min_max(view(spark, sf, "probe"), ["speed", "travel_time"]).select(
        "event_id", "speed", "travel_time"))


@query("A21_standardize", with_views("SELECT event_id, " + ", ".join(
    r(f"({f} - (SELECT avg({f}) FROM probe)) / (SELECT stddev_pop({f}) FROM probe)", f)
    for f in ("speed", "travel_time")) + " FROM probe", "probe"))
def a21(spark, sf):
    return rounded(agg.standardize(view(spark, sf, "probe"), ["speed", "travel_time"]).select(
        "event_id", "speed", "travel_time"))


@query("A22_nonzero_by_choice_set", with_views(
    "SELECT o, d, path_id, trips - 1 AS z FROM path_trips WHERE trips - 1 <> 0", "path_trips"))
def a22(spark, sf):
    return agg.nonzero_by_choice_set(network(spark, sf).paths.withColumn("z", C("trips") - 1), "z")


@query("A23_nonzero_cells", with_views(
    "SELECT u, v, 'c' AS feature, c AS value FROM links WHERE c <> 0 UNION ALL "
    "SELECT u, v, 's', s FROM links WHERE s <> 0", "links"))
def a23(spark, sf):
    return agg.feature_entries(network(spark, sf).links, ["u", "v"], ["c", "s"])


@query("A24_feature_vectors", with_views(
    "SELECT u, v, printf('%.3f|%.3f|%.3f', tt, c, s) AS z FROM links", "links"))
def a24(spark, sf):
    out = agg.feature_vectors(network(spark, sf).links, ["u", "v"], ["tt", "c", "s"])
    z = [F.element_at("z", i) for i in (1, 2, 3)]
    return out.select("u", "v", F.format_string("%.3f|%.3f|%.3f", *z).alias("z"))


# ordering ------------------------------------------------------------------------------

@query("W03_cumulative_demand", with_views(f"""
SELECT o, d, q, row_number() OVER w AS rank, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_q,
       {r("100 * sum(q) OVER (w ROWS UNBOUNDED PRECEDING) / sum(q) OVER ()", "cum_share")}
FROM od WINDOW w AS (ORDER BY q DESC, o, d)""", "od"))
def w03(spark, sf):
    return rounded(agg.cumulative_demand(network(spark, sf).od))


@query("W04_sample_by_demand", with_views("""
SELECT o, d, q FROM (SELECT *, row_number() OVER (ORDER BY q DESC, o, d) AS pos, count(*) OVER () AS n FROM od)
WHERE pos > (7 % floor(n / ceil(0.21 * n))) * ceil(0.21 * n)
  AND pos <= (7 % floor(n / ceil(0.21 * n)) + 1) * ceil(0.21 * n)""", "od"))
def w04(spark, sf):
    return agg.sample_by_demand(network(spark, sf).od, 0.21, 7).select("o", "d", "q")


_ITERS = """
SELECT u, v, i AS iter, load * (1 + CAST((u * 3 + v + i * 7) % 11 AS DOUBLE) / 20 * (CASE WHEN (u + v) % 6 = 0 THEN 0 ELSE 1 END)) AS x,
       coalesce(load * (1 + CAST((u * 3 + v + i * 7) % 11 AS DOUBLE) / 20 * (CASE WHEN (u + v) % 6 = 0 THEN 0 ELSE 1 END)) - count, 0) AS err
FROM links, (SELECT unnest([1, 2, 3, 4]) AS i)"""


def iterations(spark, sf):
    df = network(spark, sf).links.withColumn("iter", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    wave = ((C("u") * 3 + C("v") + C("iter") * 7) % 11).cast("double") / 20
    moves = F.when((C("u") + C("v")) % 6 == 0, 0).otherwise(1)
    x = C("load") * (1 + wave * moves)
    return df.select("u", "v", "iter", x.alias("x"),
                     F.coalesce(x - C("count"), F.lit(0.0)).alias("err"))


@query("W07_error_change", with_views(f"""
SELECT u, v, iter, {r("err - lag(err) OVER (PARTITION BY u, v ORDER BY iter)", "d_error")}
FROM it""", "links", it=_ITERS))
def w07(spark, sf):
    from ..scale import lagged
    out = lagged(iterations(spark, sf), ["u", "v"], [C("iter")], {"_prev": ("err", 1)})
    return rounded(out.select("u", "v", "iter", (C("err") - C("_prev")).alias("d_error")))


@query("P11_informative_links", with_views(f"""
SELECT u, v, {r("max(d)", "top_change")}
FROM (SELECT u, v, err - lag(err) OVER (PARTITION BY u, v ORDER BY iter) AS d FROM it)
GROUP BY u, v HAVING NOT abs(max(d)) <= 1e-10""", "links", it=_ITERS))
def p11(spark, sf):
    from ..operators.filters import informative_links
    return rounded(informative_links(iterations(spark, sf)))


@query("W08_best_iteration", with_views(f"""
SELECT iter, {r("objective", "objective", 3)} FROM (
  SELECT iter, sum(err * err) AS objective FROM it GROUP BY iter) ORDER BY objective, iter LIMIT 1""",
    "links", it=_ITERS))
def w08(spark, sf):
    log = iterations(spark, sf).groupBy("iter").agg(F.sum(C("err") * C("err")).alias("objective"))
    return rounded(agg.best_iteration(log), 3)


@query("W09_sequential_keys", """
SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS key FROM supplier""")
def w09(spark, sf):
    return agg.sequential_keys(table(spark, sf, "supplier").select(C("s_suppkey").alias("id")))


_SCAN = """
SELECT l_suppkey AS g, l_linenumber AS step, sum(l_quantity) AS objective
FROM lineitem GROUP BY l_suppkey, l_linenumber"""


@query("W11_first_decrease", with_views("""
SELECT s.g, max(s.step) AS step, max_by(s.objective, s.step) AS objective
FROM scan s LEFT JOIN (
  SELECT g, min(step) AS stop FROM (SELECT *, lag(objective) OVER (PARTITION BY g ORDER BY step) AS prev FROM scan)
  WHERE objective <= prev GROUP BY g) t ON t.g = s.g
WHERE stop IS NULL OR step < stop GROUP BY s.g""", scan=_SCAN))
def w11(spark, sf):
    scan = table(spark, sf, "lineitem").groupBy(
        C("l_suppkey").alias("g"), C("l_linenumber").alias("step")).agg(
        F.sum("l_quantity").alias("objective"))
    return agg.first_decrease(scan, ["g"])


@query("T03_lowest_share", with_views(f"""
SELECT u, v, {r("sq", "sq_err", 4)} FROM (
  SELECT *, row_number() OVER (ORDER BY sq, u, v) AS pos, count(*) OVER () AS n FROM (
    SELECT u, v, round(pow(load - count, 2), 9) AS sq FROM links WHERE count IS NOT NULL))
WHERE pos <= floor(n * 80.0 / 100)""", "links"))
def t03(spark, sf):
    seen = network(spark, sf).links.where("count IS NOT NULL").select(
        "u", "v", F.round(F.pow(C("load") - C("count"), 2), 9).alias("sq_err"))
    return rounded(agg.lowest_share(seen, "sq_err", 80.0, ["u", "v"]), 4)


# reports -------------------------------------------------------------------------------

@query("U01_union_stages", with_views("""
SELECT 'norefined' AS stage, o, d, q, CAST(NULL AS VARCHAR) AS note FROM od UNION ALL
SELECT 'refined', o, d, q * 2, 'x' FROM od""", "od"))
def u01(spark, sf):
    od = network(spark, sf).od
    return rs.stages(norefined=od, refined=od.select("o", "d", (C("q") * 2).alias("q"),
                                                     F.lit("x").alias("note")))


_IT_COLS = ", ".join(r(f"max(CASE WHEN iter = {i} THEN x END)", f"iter_{i}") for i in (1, 2, 3, 4))
_IT_GAPS = ", ".join(r(f"max(CASE WHEN iter = {i} THEN x END) - any_value(l.count)", f"iter_{i}")
                     for i in (1, 2, 3, 4))


def _wide_sql(cols: str) -> str:
    return with_views(f"""
SELECT it.u, it.v, {cols}, CASE WHEN any_value(l.count) IS NULL THEN 0 ELSE 1 END AS observed,
       {r("any_value(l.count)", "true_count")}
FROM it JOIN links l ON l.u = it.u AND l.v = it.v GROUP BY it.u, it.v""", "links", it=_ITERS)


@query("R01_predicted_by_iteration", _wide_sql(_IT_COLS))
def r01(spark, sf):
    return rounded(rs.predicted_by_iteration(iterations(spark, sf), network(spark, sf).links,
                                             [1, 2, 3, 4]))


@query("R02_gap_by_iteration", _wide_sql(_IT_GAPS))
def r02(spark, sf):
    return rounded(rs.predicted_by_iteration(iterations(spark, sf), network(spark, sf).links,
                                             [1, 2, 3, 4], gap=True))


@query("R03_times_by_iteration", with_views("SELECT it.u, it.v, " + ", ".join(
    r(f"max(CASE WHEN iter = {i} THEN tf * (1 + alpha * pow(x / k, beta)) END)", f"iter_{i}")
    for i in (1, 2, 3, 4)) + " FROM it JOIN links l ON l.u = it.u AND l.v = it.v GROUP BY it.u, it.v",
    "links", it=_ITERS))
def r03(spark, sf):
    from ..functions.scalars import bpr_time
    net = network(spark, sf)
    log = iterations(spark, sf).join(net.links.select("u", "v", "tf", "k", "alpha", "beta"),
                                     ["u", "v"])
    return rounded(rs.by_iteration(log.withColumn("tt", bpr_time("x")), "tt", [1, 2, 3, 4]))


_LOG = """
SELECT l_linenumber AS iter, CASE l_returnflag WHEN 'A' THEN 'tt' WHEN 'N' THEN 'c' ELSE 's' END AS parameter,
       l_linestatus AS half, avg(l_discount) - CAST(0.05 AS DOUBLE) AS est FROM lineitem GROUP BY ALL"""
_TOTAL = """
SELECT l_linenumber AS iter, l_linestatus AS half, sum(l_quantity) AS objective, count(*) AS n_paths
FROM lineitem GROUP BY ALL"""
_CONV = ("""
SELECT stage, iter, theta_tt, theta_c, theta_s, objective, n_paths, theta_tt / nullif(theta_c, 0) AS vot
FROM (SELECT CASE half WHEN 'F' THEN 'norefined' ELSE 'refined' END AS stage,
        CASE half WHEN 'F' THEN iter ELSE iter + (SELECT max(iter) FROM log WHERE half = 'F') END AS iter,
        """ + ", ".join(f"max(CASE WHEN parameter = '{p}' THEN est END) AS theta_{p}"
                        for p in ("tt", "c", "s"))
         + """, max(objective) AS objective, max(n_paths) AS n_paths
      FROM log JOIN total USING (iter, half) GROUP BY half, iter)""")


def convergence(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.when(C("l_returnflag") == "A", "tt").when(C("l_returnflag") == "N", "c").otherwise("s")
    log = li.groupBy(C("l_linenumber").alias("iter"), name.alias("parameter"),
                     C("l_linestatus").alias("half")).agg((F.avg("l_discount") - 0.05).alias("est"))
    total = li.groupBy(C("l_linenumber").alias("iter"), C("l_linestatus").alias("half")).agg(
        F.sum("l_quantity").alias("objective"), F.count(F.lit(1)).alias("n_paths"))
    both = log.join(total, ["iter", "half"])
    return rs.convergence_table(both.where("half = 'F'").drop("half"),
                                both.where("half <> 'F'").drop("half"), ["tt", "c", "s"])


@query("R04_convergence", with_views(
    "SELECT stage, iter, n_paths, objective, "
    + ", ".join(r(c, c) for c in ("theta_tt", "theta_c", "theta_s")) + f", {r('vot', 'vot', 4)} FROM conv",
    log=_LOG, total=_TOTAL, conv=_CONV))
def r04(spark, sf):
    return rounded(convergence(spark, sf), vot=4)


@query("R05_estimate_gaps", with_views(
    f"SELECT stage, iter, n_paths, {r('theta_tt + 1', 'gap_theta_tt')}, {r('theta_c - 0.5::DOUBLE', 'gap_theta_c')}, "
    f"{r('theta_s', 'theta_s')}, {r('vot + 2', 'gap_vot', 4)} FROM conv",
    log=_LOG, total=_TOTAL, conv=_CONV))
def r05(spark, sf):
    return rounded(rs.estimate_gaps(convergence(spark, sf), {"tt": -1.0, "c": 0.5}), gap_vot=4)


#: An infinite capacity is compared as a flag and no number.
_SHOWN = "CASE WHEN k <= 10000 THEN k END"


def _bounded(shown):
    infinite = C("capacity") == float("inf")
    return shown.withColumn("unbounded", infinite).withColumn("capacity", F.when(~infinite, C("capacity")))


@query("R06_link_summary", with_views(
    f"SELECT u, v, link_type, {r('length', 'length')}, tf, {r(_SHOWN, 'capacity')}, k > 10000 AS unbounded, "
    f"alpha, beta, {r('count', 'count')} FROM links", "links"))
def r06(spark, sf):
    return rounded(_bounded(rs.link_summary(network(spark, sf).links)), alpha=-1, beta=-1)


_TT = "tf * (1 + alpha * pow(load / k, beta))"


@query("R07_link_report", with_views(f"""
SELECT u, v, {r(_SHOWN, "capacity")}, k > 10000 AS unbounded, {r(_TT, "tt")}, round(60 * length / ({_TT}), 1) AS speed,
       {r("count", "count")}, {r("load", "predicted")}, {r("load - count", "error")}
FROM links WHERE count IS NOT NULL""", "links"))
def r07(spark, sf):
    links = network(spark, sf).links
    return rounded(_bounded(rs.link_report(links, links.withColumn("x", C("load")))), speed=-1)


# the columns are the destinations of the table; the long form has a row for each cell
@query("R08_od_matrix", with_views("""
SELECT a.o, 'd' || b.d AS destination, coalesce(od.q, 0) AS q
FROM (SELECT DISTINCT o FROM od) a JOIN (SELECT DISTINCT d FROM od) b ON true
LEFT JOIN od ON od.o = a.o AND od.d = b.d""", "od"))
def r08(spark, sf):
    wide = rs.od_matrix(network(spark, sf).od)
    return wide.unpivot("o", [c for c in wide.columns if c != "o"], "destination", "q")


@query("R10_melt", """
SELECT l_orderkey, l_partkey, l_linenumber, variable, value FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))""")
def r10(spark, sf):
    return rs.melt(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"],
                   ["l_quantity", "l_discount", "l_tax"])


@query("R12_scatter_sample", with_views(f"""
SELECT event_id, {r("speed", "speed")}, {r("travel_time", "travel_time")} FROM probe
WHERE ('0x' || md5('5:' || event_id)[1:8])::BIGINT < {int(0.3 * (1 << 32))}""", "probe"))
def r12(spark, sf):
    probe = view(spark, sf, "probe").select("event_id", "speed", "travel_time")
    return rounded(rs.scatter_sample(probe, "event_id", 0.3, 5))


@query("K05_inference_table", with_views(
    "SELECT 'norefined' AS stage, parameter, " + f"{r('avg(est)', 'est')} FROM log WHERE half = 'F' GROUP BY parameter "
    f"UNION ALL SELECT 'refined', parameter, {r('avg(est)', 'est')} FROM log WHERE half <> 'F' GROUP BY parameter",
    log=_LOG))
def k05(spark, sf):
    from ..sources.sinks import inference_table
    li = table(spark, sf, "lineitem")
    name = F.when(C("l_returnflag") == "A", "tt").when(C("l_returnflag") == "N", "c").otherwise("s")
    log = li.groupBy(C("l_linenumber").alias("iter"), name.alias("parameter"),
                     C("l_linestatus").alias("half")).agg((F.avg("l_discount") - 0.05).alias("est"))
    half = [log.where(w).groupBy("parameter").agg(F.avg("est").alias("est"))
            for w in ("half = 'F'", "half <> 'F'")]
    return rounded(inference_table(*half))
