import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from flowgrain.functions import metrics, scalars as fn
from flowgrain.operators import aggregates as agg
from flowgrain.operators import filters as flt
from flowgrain.operators import joins as jn
from flowgrain.operators import reshape as rs
from flowgrain.operators import sampling as sm


@pytest.fixture(scope="module")
def clock(spark):
    rows = [(h * 60 + m, dt.datetime(2019, 10, 1, h, m)) for h in range(24) for m in range(0, 60, 5)]
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz")


def test_one_hour_is_half_open_or_two_clock_hours(clock):
    exact = flt.clock_interval(clock, 16, 60)
    assert {r["id"] for r in exact.collect()} == set(range(960, 1020, 5))
    compat = flt.clock_interval(clock, 16, 60, compat=True)
    assert {r["id"] for r in compat.collect()} == set(range(960, 1080, 5))


def test_compat_remainder_keeps_the_last_hour_only(clock):
    got = {r["id"] for r in flt.clock_interval(clock, 16, 90, compat=True).collect()}
    assert got == set(range(1020, 1051, 5))


def test_selected_period(clock):
    period = flt.select_period("2019-10-01", 16)
    assert period == {"year": 2019, "month": 10, "day_month": 1, "day_week": 3, "hour": 16}
    assert flt.period_filter(flt.date_parts(clock), period).count() == 12
    assert flt.period_filter(flt.date_parts(clock), {}).count() == clock.count()


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("10/01/2019 16:05:00", "7"), ("2019-10-01", "x"), (None, None)],
                               "t string, n string")
    got = df.select(fn.feed_time("t").alias("t"), fn.as_number("n").alias("n")).collect()
    assert got[0]["t"] == dt.datetime(2019, 10, 1, 16, 5) and got[0]["n"] == 7.0
    assert got[1]["t"] is None and got[1]["n"] is None and got[2]["t"] is None


def test_capacity_divisor(spark):
    df = spark.createDataFrame([(100.0, 50.0), (101.0, 50.0), (10.0, 50.0), (None, 50.0), (5.0, 0.0)],
                               "c double, k double")
    got = [r[0] for r in df.select(fn.capacity_divisor("c", "k")).collect()]
    assert got == [2.0, 3.0, 1.0, None, None]


def test_bpr_forms(spark):
    df = spark.createDataFrame([(2.0, 10.0, 0.15, 4.0, 20.0)], "tf double, k double, alpha double, beta double, x double")
    r = df.select(fn.bpr_time("x").alias("t"), fn.bpr_integral("x").alias("a"),
                  fn.bpr_integral("x", constant_term=True).alias("b")).first()
    assert r["t"] == pytest.approx(2 * (1 + 0.15 * 16))
    assert r["a"] == pytest.approx(2 * (20 + 0.15 / 5 * 16 * 20))
    assert r["b"] == pytest.approx(2 * (1 + 0.15 / 5 * 16 * 20))


def test_lane_counts_fall_back_to_all_lanes(spark):
    links = spark.createDataFrame([(1, 2, 1, [5, 6]), (3, 4, 7, [5]), (5, 6, 1, [9]), (7, 8, 1, [])],
                                  "u int, v int, lane int, station_ids array<int>")
    lanes = ", ".join(f"flow_total_lane_{i} double" for i in range(1, 9))
    counts = spark.createDataFrame([(5, 10.0, 30.0, *[None] * 6), (6, 20.0, *[None] * 7)],
                                   f"station_id int, {lanes}")
    got = {r["u"]: (r["count"], r["matched"], r["imputed"]) for r in
           jn.link_lane_counts(links, counts).collect()}
    assert got == {1: (15.0, 1, 0), 3: (20.0, 0, 1), 5: (None, 0, 0), 7: (None, 0, 0)}


def test_strict_attach(spark):
    links = spark.createDataFrame([(1, 2), (3, 4)], "u int, v int")
    some = spark.createDataFrame([(1, 2, 9.0)], "u int, v int, z double")
    with pytest.raises(ValueError):
        jn.attach(links, some, strict=True)
    assert {r["z"] for r in jn.attach(links, some).collect()} == {9.0, None}


def test_resample_fills_empty_bins(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 5), 2.0), (1, dt.datetime(2024, 1, 1, 0, 20), 3.0),
            (1, dt.datetime(2024, 1, 1, 2, 0), 4.0)]
    df = spark.createDataFrame(rows, "station_id int, ts timestamp, flow_total double")
    got = [r["flow_total"] for r in agg.resample(df).orderBy("bin").collect()]
    assert got == [5.0, 0.0, 0.0, 0.0, 4.0]


def test_metrics_by_hand(spark):
    a, p = [2.0, 4.0, 7.0, None, 1.0], [1.0, 5.0, 7.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, p))],
                               "t int, actual double, predicted double")
    names = ["mse", "mae", "gmae", "mdae", "mase", "mda", "rae", "inrse", "std_ae", "mape"]
    r = metrics.evaluate(df, names, order=[F.col("t")]).first()
    e = [1.0, -1.0, 0.0, -3.0]
    assert r["mse"] == pytest.approx(11 / 4) and r["mae"] == pytest.approx(5 / 4)
    assert r["gmae"] == 0.0 and r["mdae"] == pytest.approx(1.0)
    assert r["mase"] == pytest.approx(1.25 / ((2 + 3 + 6) / 3))
    assert r["mda"] == pytest.approx(1.0)
    assert r["rae"] == pytest.approx(5 / (1.5 + 0.5 + 3.5 + 2.5))
    assert r["inrse"] == pytest.approx(math.sqrt(11 / (2.25 + 0.25 + 12.25 + 6.25)))
    assert r["std_ae"] == pytest.approx(math.sqrt(sum((x - 1.25) ** 2 for x in e) / 3))
    with pytest.raises(ValueError):
        metrics.evaluate(df, ["nothing"])


def test_metrics_on_long_series(spark, monkeypatch):
    """The chunked lag and ranked medians give what the plain ones give."""
    from flowgrain import scale
    df = spark.range(300).select(
        F.lit(1).alias("s"), F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("actual"),
        ((F.col("id") * 53) % 97).cast("double").alias("predicted"))
    names = ["mase", "mda", "mdae", "rmdspe", "mbrae"]
    want = metrics.evaluate(df, names, ["s"], [F.col("id")]).first()
    for f in ("lagged", "percentiles"):
        real = getattr(scale, f)
        monkeypatch.setattr(metrics, f, lambda *a, real=real, **k: real(*a, **k, group_rows=40))
    got = metrics.evaluate(df, names, ["s"], [F.col("id")]).first()
    for n in names:
        assert got[n] == pytest.approx(want[n])


def test_informative_links(spark):
    log = spark.createDataFrame([(1, 2, i, 5.0) for i in range(3)] + [(3, 4, i, 5.0 + i) for i in range(3)],
                                "u int, v int, iter int, err double")
    assert [(r["u"], r["top_change"]) for r in flt.informative_links(log).collect()] == [(3, 1.0)]


def test_convergence_renumbers_and_divides(spark):
    s = "iter int, parameter string, est double, objective double, n_paths long"
    a = spark.createDataFrame([(1, "tt", -1.0, 9.0, 4), (1, "c", 0.0, 9.0, 4)], s)
    b = spark.createDataFrame([(1, "tt", -1.0, 8.0, 5), (1, "c", -2.0, 8.0, 5)], s)
    rows = rs.convergence_table(a, b, ["tt", "c"]).orderBy("iter").collect()
    assert [(r["stage"], r["iter"], r["vot"]) for r in rows] == [("norefined", 1, None), ("refined", 2, 0.5)]


def test_sampling_is_repeatable_and_exact(spark):
    df = spark.createDataFrame([(i, i + 1, float(i)) for i in range(50)], "u int, v int, count double")
    a = {r["u"] for r in sm.random_share(df, ["u", "v"], 0.3, 1).collect()}
    b = {r["u"] for r in sm.random_share(df.repartition(7), ["u", "v"], 0.3, 1).collect()}
    c = {r["u"] for r in sm.random_share(df, ["u", "v"], 0.3, 2).collect()}
    assert a == b and len(a) == 15 and a != c
    masked = sm.mask_by_coverage(df, ["u", "v"], 0.6, 1)
    assert masked.where("count IS NOT NULL").count() == 30
    assert masked.where("count IS NULL AND withdrawn IS NULL").count() == 0


def test_noise(spark):
    df = spark.createDataFrame([(i, i + 1, 50.0) for i in range(4000)], "u int, v int, count double")
    r = sm.noisy_counts(df, sd=0.1, seed=4).agg(F.avg("count"), F.stddev("count"), F.min("count")).first()
    assert r[0] == pytest.approx(50, abs=0.5) and r[1] == pytest.approx(5, abs=0.3) and r[2] >= 0
    od = df.select(F.col("u").alias("o"), F.col("v").alias("d"), F.lit(6.0).alias("q"))
    r = sm.noisy_demand(od, "poisson", 4).agg(F.avg("q"), F.variance("q")).first()
    assert r[0] == pytest.approx(6, abs=0.2) and r[1] == pytest.approx(6, abs=0.6)


def test_link_ids(spark):
    df = spark.createDataFrame([("1-2",), ("1-2-0",), ("1",), ("1-b",), ("1-2-3-4",)], "id string")
    assert [r[0] for r in df.select(flt.valid_link_id("id")).collect()] == [True, True, False, False, False]
