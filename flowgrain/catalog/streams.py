"""Streaming queries: the events file read as a stream and run until all input is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import feeds as st
from .bindings import network, table, utc, with_views
from .common import r, rounded
from .registry import query

C = F.col


def _events(spark, sf):
    utc(spark)
    return st.file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def _counts(spark, sf):
    flow = F.when(C("event_id") % 17 != 0, C("value"))
    return _events(spark, sf).select("event_id", "ts", C("user_id").alias("station_id"),
                                     flow.alias("flow_total"))


# append mode gives the windows the watermark has passed
_CLOSED = "(SELECT max(ts) - INTERVAL 15 MINUTE FROM events)"


@query("X01_stream_window_sums", with_views(f"""
SELECT station_id, bin, {r("coalesce(sum(flow_total), 0)", "flow_total", 2)}, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS bin FROM counts)
WHERE bin + INTERVAL 30 MINUTE <= {_CLOSED} GROUP BY station_id, bin""", "counts"))
def x01(spark, sf):
    got = st.run_to_files(st.window_sums(_counts(spark, sf)))
    return rounded(got.withColumn("bin", C("bin").cast("timestamp_ntz")), 2)


@query("X02_stream_rolling", with_views(f"""
SELECT segment_id, bin, {r("avg(speed)", "speed_avg")}, {r("stddev_samp(speed)", "speed_sd")}, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS bin
      FROM probe, (SELECT unnest(range(4)) AS k))
WHERE bin + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY segment_id, bin""", "probe"))
def x02(spark, sf):
    probe = _events(spark, sf).select("ts", C("user_id").alias("segment_id"), C("value").alias("speed"))
    got = st.run_to_files(st.rolling_statistics(probe))
    return rounded(got.withColumn("bin", C("bin").cast("timestamp_ntz")))


@query("X03_stream_incidents", with_views("""
SELECT l.u, l.v, p.event_id FROM incidents p JOIN links l ON sqrt(
  pow(p.x - l.x1 - least(greatest(((p.x - l.x1) * (l.x2 - l.x1) + (p.y - l.y1) * (l.y2 - l.y1)) / (l.length * l.length), 0), 1) * (l.x2 - l.x1), 2)
  + pow(p.y - l.y1 - least(greatest(((p.x - l.x1) * (l.x2 - l.x1) + (p.y - l.y1) * (l.y2 - l.y1)) / (l.length * l.length), 0), 1) * (l.y2 - l.y1), 2))
  <= 0.9123""", "incidents", "links"))
def x03(spark, sf):
    e = _events(spark, sf).select(
        "event_id", (C("event_id") * 37 % 1010).cast("double").__truediv__(10).alias("x"),
        (C("event_id") * 53 % 970).cast("double").__truediv__(10).alias("y"))
    near = st.incidents_near_links(e, network(spark, sf).links, 0.9123)
    return st.run_to_files(near.select("u", "v", "event_id"))


@query("X04_stream_changes", with_views(f"""
SELECT station_id, event_id, {r("change", "change")} FROM (
  SELECT station_id, event_id, ts, flow_total - lag(flow_total) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS change
  FROM (SELECT user_id AS station_id, event_id, ts, value AS flow_total FROM events))
WHERE ts < {_CLOSED}"""))
def x04(spark, sf):
    readings = _events(spark, sf).select("event_id", "ts", C("user_id").alias("station_id"),
                                         C("value").alias("flow_total"))
    return rounded(st.run_to_files(st.changes(readings)))
