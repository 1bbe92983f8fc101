"""Feed queries: periods, date parts, station and segment aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import aggregates as agg
from ..operators import filters as flt
from .bindings import view, with_views
from .common import r, rounded
from .registry import query

C = F.col

# DuckDB twins of the date parts; its week starts at 0.
PARTS = ("year(ts) AS year, month(ts) AS month, day(ts) AS day_month, "
         "dayofweek(ts) + 1 AS day_week, hour(ts) AS hour, minute(ts) AS minute")


@query("P01_period_filter", with_views(f"""
SELECT event_id, station_id, CAST(day_week AS INTEGER) AS day_week, CAST(hour AS INTEGER) AS hour
FROM (SELECT *, {PARTS} FROM counts)
WHERE year IN (2024) AND month IN (1) AND day_week IN (1, 2, 3, 4, 5)
  AND hour IN (6, 7, 8, 9, 16, 17, 18, 19)""", "counts"))
def p01(spark, sf):
    df = flt.date_parts(view(spark, sf, "counts"))
    period = {"year": 2024, "month": [1], "day_week": [1, 2, 3, 4, 5],
              "hour": [6, 7, 8, 9, 16, 17, 18, 19]}
    return flt.period_filter(df, period).select("event_id", "station_id", "day_week", "hour")


@query("P01_selected_day", with_views(f"""
SELECT event_id, segment_id FROM (SELECT *, {PARTS} FROM probe)
WHERE year = 2024 AND month = 1 AND day_month = 16 AND day_week = 3 AND hour = 16""", "probe"))
def p01_day(spark, sf):
    df = flt.date_parts(view(spark, sf, "probe"), "ts", "dt")
    period = flt.select_period("2024-01-16", 16)
    return flt.period_filter(df, period, "dt").select("event_id", "segment_id")


@query("P02_clock_interval", with_views("""
SELECT event_id, station_id FROM counts
WHERE hour(ts) * 60 + minute(ts) >= 960 AND hour(ts) * 60 + minute(ts) < 1050""", "counts"))
def p02(spark, sf):
    return flt.clock_interval(view(spark, sf, "counts"), 16, 90).select("event_id", "station_id")


@query("P02_clock_interval_compat", with_views("""
SELECT event_id, station_id FROM counts
WHERE hour(ts) >= 16 AND hour(ts) <= 17 AND hour(ts) >= 17 AND minute(ts) <= 30""", "counts"))
def p02_compat(spark, sf):
    return flt.clock_interval(view(spark, sf, "counts"), 16, 90, compat=True).select(
        "event_id", "station_id")


@query("P03_date_parts", with_views("""
SELECT event_id, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month,
       CAST(day(dt) AS INTEGER) AS day_month, CAST(dayofweek(dt) + 1 AS INTEGER) AS day_week,
       CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute
FROM probe""", "probe"))
def p03(spark, sf):
    return flt.date_parts(view(spark, sf, "probe"), "ts", "dt").select(
        "event_id", "year", "month", "day_month", "day_week", "hour", "minute")


@query("P05_drop_missing", with_views(
    "SELECT event_id, station_id, flow_total FROM counts WHERE flow_total IS NOT NULL", "counts"))
def p05(spark, sf):
    return flt.drop_missing(view(spark, sf, "counts"), ["flow_total"]).select(
        "event_id", "station_id", "flow_total")


_LANE_SUMS = ", ".join(r(f"sum(flow_total_lane_{i})", f"flow_total_lane_{i}", 2)
                       for i in range(1, 9))


@query("A01_station_counts", with_views(f"""
SELECT station_id, {r("sum(flow_total)", "flow_total", 2)}, {_LANE_SUMS},
       {r("avg(flow_total)", "flow_total_avg")}, {r("stddev_samp(flow_total)", "flow_total_sd")}
FROM counts WHERE flow_total IS NOT NULL GROUP BY station_id""", "counts"))
def a01(spark, sf):
    return rounded(agg.station_counts(view(spark, sf, "counts")))


_STATS = ", ".join(
    [f"CAST(count(speed) AS BIGINT) AS n"]
    + [r(f"{f}({c})", f"{c}_{s}") for c in ("speed", "speed_hist", "speed_ref")
       for f, s in (("avg", "avg"), ("stddev_samp", "sd"), ("var_samp", "var"))]
    + [r("min(speed)", "speed_min"), r("max(speed)", "speed_max")]
    + [r(f"{f}(travel_time)", f"traveltime_{s}") for f, s in (
        ("min", "min"), ("max", "max"), ("avg", "avg"), ("stddev_samp", "sd"),
        ("var_samp", "var"))]
    + [r("avg(road_closure_num)", "road_closure_avg"),
       "max(road_closure_num) AS road_closure_any"])


@query("A02_segment_statistics", with_views(
    f"SELECT segment_id, {_STATS} FROM probe WHERE speed IS NOT NULL GROUP BY segment_id",
    "probe"))
def a02(spark, sf):
    return rounded(agg.segment_statistics(view(spark, sf, "probe")))


@query("A03_variation", with_views(f"""
SELECT segment_id, {r("stddev_samp(speed) / avg(speed_hist)", "traveltime_cv")},
       {r("stddev_samp(speed) / avg(speed_hist)", "speed_cv")},
       {r("stddev_samp(travel_time) / avg(travel_time)", "traveltime_cv_true")}
FROM probe GROUP BY segment_id""", "probe"))
def a03(spark, sf):
    out = agg.variation(agg.segment_statistics(view(spark, sf, "probe")))
    return rounded(out.select("segment_id", "traveltime_cv", "speed_cv", "traveltime_cv_true"))


@query("A04_resample", with_views(f"""
SELECT g.station_id, g.bin, {r("coalesce(s.flow, 0)", "flow_total", 2)}
FROM (SELECT station_id, unnest(generate_series(min(b), max(b), INTERVAL 30 MINUTE)) AS bin
      FROM binned GROUP BY station_id) g
LEFT JOIN (SELECT station_id, b, sum(flow_total) AS flow FROM binned GROUP BY station_id, b) s
  ON s.station_id = g.station_id AND s.b = g.bin""", "counts", binned="""
SELECT station_id, flow_total, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM counts"""))
def a04(spark, sf):
    out = agg.resample(view(spark, sf, "counts"))
    return rounded(out.withColumn("bin", C("bin").cast("timestamp_ntz")), 2)


@query("A05_distinct_days", with_views("SELECT DISTINCT dt FROM probe", "probe"))
def a05(spark, sf):
    return agg.distinct_days(view(spark, sf, "probe"))


@query("A05_distinct_years", with_views(
    "SELECT DISTINCT CAST(year(dt) AS INTEGER) AS year FROM probe", "probe"))
def a05_years(spark, sf):
    return agg.distinct_years(view(spark, sf, "probe"))


@query("F04_km_to_miles", with_views(
    f"SELECT event_id, {r('speed * CAST(0.62137119223 AS DOUBLE)', 'speed')} FROM probe", "probe"))
def f04(spark, sf):
    return rounded(view(spark, sf, "probe").select("event_id", fn.km_to_miles("speed").alias("speed")))


@query("F05_feed_time", with_views("""
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed
FROM counts""", "counts"))
def f05(spark, sf):
    text = F.when(C("event_id") % 19 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
    return view(spark, sf, "counts").select(
        "event_id", fn.feed_time(text).cast("timestamp_ntz").alias("parsed"))


@query("F06_text_flag", with_views(
    "SELECT event_id, CASE WHEN road_closure = 'T' THEN 1 ELSE 0 END AS closed FROM probe",
    "probe"))
def f06(spark, sf):
    return view(spark, sf, "probe").select("event_id", fn.text_flag("road_closure").alias("closed"))


@query("W05_seasonal_lag", with_views("""
SELECT event_id, station_id,
       lag(flow_total, 1) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS lag_1,
       lag(flow_total, 7) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS lag_7
FROM counts""", "counts"))
def w05(spark, sf):
    from ..scale import lagged
    out = lagged(view(spark, sf, "counts"), ["station_id"], [C("ts"), C("event_id")],
                 {"lag_1": ("flow_total", 1), "lag_7": ("flow_total", 7)})
    return out.select("event_id", "station_id", "lag_1", "lag_7")


@query("W06_direction", with_views("""
SELECT event_id, segment_id,
       CAST(sign(speed - lag(speed) OVER (PARTITION BY segment_id ORDER BY ts, event_id))
            AS DOUBLE) + 0 AS direction
FROM probe""", "probe"))
def w06(spark, sf):
    from ..scale import lagged
    out = lagged(view(spark, sf, "probe"), ["segment_id"], [C("ts"), C("event_id")],
                 {"_prev": ("speed", 1)})
    return rounded(out.select("event_id", "segment_id",
                              F.signum(C("speed") - C("_prev")).alias("direction")))


# error metrics -------------------------------------------------------------------------

PAIRS = """
SELECT user_id AS series, event_id, ts, CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END AS actual,
       value * 0.9 + 0.7 + (event_id % 5) AS predicted
FROM events"""
_SEEN = "SELECT *, actual - predicted AS e FROM pairs WHERE actual IS NOT NULL"
_LAGS = """
SELECT *, lag(actual) OVER w AS la, lag(predicted) OVER w AS lp FROM seen
WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)"""
_MEANS = """
SELECT l.*, avg(actual) OVER (PARTITION BY series) AS abar,
       avg(abs(e)) OVER (PARTITION BY series) AS m_ae,
       avg(abs(e / (actual + 1e-10))) OVER (PARTITION BY series) AS m_ape FROM lags l"""
_PE = "(e / (actual + 1e-10))"
_SM = "(2 * abs(e) / (abs(actual) + abs(predicted) + 1e-10))"
_RE = "(e / (actual - la + 1e-10))"
_BR = "(abs(e) / (abs(e) + abs(actual - la) + 1e-10))"
_NAIVE = "avg(abs(actual - la))"
METRIC_SQL = {
    "M01_mse": "avg(e * e)", "M02_rmse": "sqrt(avg(e * e))",
    "M03_nrmse": "sqrt(avg(e * e)) / avg(actual)", "M04_me": "avg(e)",
    "M05_mae": "avg(abs(e))",
    "M06_gmae": "CASE WHEN min(abs(e)) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN abs(e) > 0 THEN abs(e) END))) END",
    "M07_mdae": "median(abs(e))", "M08_mpe": f"avg({_PE})", "M09_mape": f"avg(abs({_PE}))",
    "M10_mdape": f"median(abs({_PE}))", "M11_smape": f"avg({_SM})",
    "M12_smdape": f"median({_SM})", "M13_maape": f"avg(atan(abs({_PE})))",
    "M14_mase": f"avg(abs(e)) / {_NAIVE}",
    "M15_std_ae": "sqrt(sum((e - m_ae) * (e - m_ae)) / (count(*) - 1))",
    "M16_std_ape": f"sqrt(sum(({_PE} - m_ape) * ({_PE} - m_ape)) / (count(*) - 1))",
    "M17_rmspe": f"sqrt(avg({_PE} * {_PE}))", "M18_rmdspe": f"sqrt(median({_PE} * {_PE}))",
    "M19_rmsse": f"sqrt(avg(e * e)) / {_NAIVE}",
    "M20_inrse": "sqrt(sum(e * e) / sum((actual - abar) * (actual - abar)))",
    "M21_rrse": "sqrt(sum(e * e) / sum((actual - abar) * (actual - abar)))",
    "M22_mre": f"avg({_RE})",
    "M23_rae": "sum(abs(e)) / (sum(abs(actual - abar)) + 1e-10)",
    "M24_mrae": f"avg(abs({_RE}))", "M25_mdrae": f"median(abs({_RE}))",
    "M26_gmrae": (f"CASE WHEN min(abs({_RE})) = 0 THEN 0 "
                  f"ELSE exp(avg(ln(CASE WHEN abs({_RE}) > 0 THEN abs({_RE}) END))) END"),
    "M27_mbrae": f"avg({_BR})", "M28_umbrae": f"avg({_BR}) / (1 - avg({_BR}))",
    "M29_mda": ("avg(CASE WHEN la IS NULL THEN NULL WHEN sign(actual - la) = sign(predicted - lp) "
                "THEN 1.0 ELSE 0.0 END)"),
}


def _metric_sql(columns: str) -> str:
    return with_views(f"SELECT series, {columns} FROM means GROUP BY series",
                      pairs=PAIRS, seen=_SEEN, lags=_LAGS, means=_MEANS)


def _pairs(spark, sf):
    from .bindings import table, utc
    utc(spark)
    return spark.sql(PAIRS.replace("FROM events", "FROM {events}"),
                     events=table(spark, sf, "events"))


def _metric(name: str, digits: int):
    from ..functions.metrics import evaluate

    def run(spark, sf):
        out = evaluate(_pairs(spark, sf), [name], ["series"], [C("ts"), C("event_id")])
        return rounded(out, digits)
    return run


# ratios to differences that can vanish reach 1e8: fewer digits of those agree
DIGITS = {"M22_mre": 2, "M24_mrae": 2}
for _key, _expr in METRIC_SQL.items():
    _name = _key.split("_", 1)[1]
    _d = DIGITS.get(_key, 4)
    query(_key, _metric_sql(r(_expr, _name, _d)))(_metric(_name, _d))


@query("M30_evaluate_all", _metric_sql(", ".join(
    r(e, k.split("_", 1)[1], 2) for k, e in METRIC_SQL.items())))
def m30(spark, sf):
    from ..functions.metrics import evaluate
    names = [k.split("_", 1)[1] for k in METRIC_SQL]
    return rounded(evaluate(_pairs(spark, sf), names, ["series"], [C("ts"), C("event_id")]), 2)


@query("M30_evaluate_overall", with_views(
    f"SELECT {r(METRIC_SQL['M02_rmse'], 'rmse', 4)}, {r(METRIC_SQL['M07_mdae'], 'mdae', 4)}, "
    f"{r('sum(abs(e)) / (sum(abs(actual - (SELECT avg(actual) FROM seen))) + 1e-10)', 'rae', 4)}, "
    f"{r(METRIC_SQL['M13_maape'], 'maape', 4)} FROM seen", pairs=PAIRS, seen=_SEEN))
def m30_overall(spark, sf):
    from ..functions.metrics import evaluate
    return rounded(evaluate(_pairs(spark, sf), ["rmse", "mdae", "rae", "maape"]), 4)


@query("V04_own_metric", with_views(
    f"SELECT series, {r('max(abs(e))', 'max_ae', 4)}, {r('avg(e * e)', 'mse', 4)} FROM seen GROUP BY series",
    pairs=PAIRS, seen=_SEEN))
def v04(spark, sf):
    from ..functions.metrics import evaluate, register_metric
    register_metric("max_ae", lambda: F.max(F.abs(C("actual") - C("predicted"))))
    return rounded(evaluate(_pairs(spark, sf), ["max_ae", "mse"], ["series"]), 4)
