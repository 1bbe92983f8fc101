"""Aggregations of feeds, link tables, paths and experiment results."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import percentiles, ranked, scalar_join
from .filters import LINK, mask_uncovered

C = F.col
LANES = [f"flow_total_lane_{i}" for i in range(1, 9)]


def station_counts(counts: DataFrame) -> DataFrame:
    """Sums of the total and of each lane, mean and deviation, per station."""
    lanes = [c for c in LANES if c in counts.columns]
    return counts.na.drop(subset=["flow_total"]).groupBy("station_id").agg(
        F.sum("flow_total").alias("flow_total"), *[F.sum(c).alias(c) for c in lanes],
        F.avg("flow_total").alias("flow_total_avg"), F.stddev("flow_total").alias("flow_total_sd"))


def segment_statistics(probe: DataFrame) -> DataFrame:
    """Speed, travel-time and closure statistics per probe segment."""
    aggs = [F.count("speed").alias("n")]
    aggs += [F.avg("speed").alias("speed_avg"), F.stddev("speed").alias("speed_sd"),
             F.variance("speed").alias("speed_var"), F.min("speed").alias("speed_min"),
             F.max("speed").alias("speed_max")]
    for name in ("speed_hist", "speed_ref"):
        aggs += [F.avg(name).alias(f"{name}_avg"), F.stddev(name).alias(f"{name}_sd"),
                 F.variance(name).alias(f"{name}_var")]
    t = "travel_time"
    aggs += [F.min(t).alias("traveltime_min"), F.max(t).alias("traveltime_max"),
             F.avg(t).alias("traveltime_avg"), F.stddev(t).alias("traveltime_sd"),
             F.variance(t).alias("traveltime_var"),
             F.avg("road_closure_num").alias("road_closure_avg"),
             F.max("road_closure_num").alias("road_closure_any")]
    return probe.na.drop(subset=["speed"]).groupBy("segment_id").agg(*aggs)


def variation(stats: DataFrame) -> DataFrame:
    """Coefficients of variation; the travel-time one repeats the speed formula by name.

    ``traveltime_cv_true`` is deviation over mean of the travel time itself.
    """
    speed = F.try_divide("speed_sd", "speed_hist_avg")
    return stats.withColumns({"traveltime_cv": speed, "speed_cv": speed,
                              "traveltime_cv_true": F.try_divide("traveltime_sd",
                                                                 "traveltime_avg")})


def resample(counts: DataFrame, minutes: int = 30, flow: str = "flow_total",
             fill: bool = True) -> DataFrame:
    """Sum per station and time bin; ``fill`` adds the empty bins in between as 0."""
    step = f"{minutes} minutes"
    sums = (counts.groupBy("station_id", F.window("ts", step).alias("_w"))
            .agg(F.coalesce(F.sum(flow), F.lit(0.0)).alias(flow))
            .select("station_id", C("_w.start").alias("bin"), flow))
    if not fill:
        return sums
    span = sums.groupBy("station_id").agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    bins = span.select("station_id", F.explode(F.sequence(
        "_lo", "_hi", F.expr(f"interval {minutes} minutes"))).alias("bin"))
    return bins.join(sums, ["station_id", "bin"], "left").na.fill(0.0, [flow])


def distinct_days(df: DataFrame, day: str = "dt") -> DataFrame:
    return df.select(day).distinct()


def distinct_years(df: DataFrame, day: str = "dt") -> DataFrame:
    return df.select(F.year(day).alias("year")).distinct()


def type_frequencies(links: DataFrame, kind: str = "link_type") -> DataFrame:
    n = links.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return scalar_join(n, {"_all": F.sum("n")}).withColumn("share", C("n") / C("_all")).drop("_all")


def network_summary(links: DataFrame, od: DataFrame, paths: DataFrame, by: str = "network"
                    ) -> DataFrame:
    """Nodes, links, OD pairs with demand and paths, per network."""
    ends = links.select(by, F.explode(F.array("u", "v")).alias("node")).distinct()
    out = ends.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"))
    for name, df in (("links", links), ("ods", od.where(C("q") != 0)), ("paths", paths)):
        out = out.join(df.groupBy(by).agg(F.count(F.lit(1)).alias(name)), by, "left")
    return out.na.fill(0)


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum, one row per feature."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), C(f).cast("double").alias("x")) for f in features]))
        .alias("p")).select("p.*")
    base = long.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = percentiles(long, ["feature"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(q, "feature").select("feature", "n", "mean", "std", "min", "p25", "p50",
                                          "p75", "max")


def link_coverage(links: DataFrame, paths: DataFrame, count: str = "count") -> DataFrame:
    """Share of links with a count, before and after dropping counts no path reaches."""
    masked = mask_uncovered(links.withColumn("_raw", C(count)), paths, count)
    return masked.agg(
        F.count(F.lit(1)).alias("n_links"), F.count("_raw").alias("n_observed"),
        F.count(count).alias("n_covered"),
        (F.count("_raw") / F.count(F.lit(1))).alias("coverage"),
        (F.count(count) / F.count(F.lit(1))).alias("adjusted_coverage"))


def demand_totals(od: DataFrame, scale: float = 1.0) -> DataFrame:
    return od.where(C("q") != 0).agg((F.sum("q") * F.lit(float(scale))).alias("trips"),
                                     F.count(F.lit(1)).alias("ods"))


def saturation(links: DataFrame, count: str = "count") -> DataFrame:
    """Count over capacity among observed links: mean, maximum, share above 1."""
    r = F.try_divide(count, "k")
    return links.where(C(count).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_ratio"), F.max(r).alias("max_ratio"),
        F.sum(F.when(r > 1, 1).otherwise(0)).alias("n_over"),
        F.avg(F.when(r > 1, 1.0).otherwise(0.0)).alias("share_over"))


def links_per_path(paths: DataFrame) -> DataFrame:
    return paths.select("path_id", F.size("segs").alias("n_links"))


def choice_set_sums(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    return df.groupBy("o", "d").agg(F.sum(value).alias(out))


def correlations(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every pair of features over complete rows, optionally per group."""
    pairs = list(combinations(features, 2))
    both = [(C(a).isNotNull() & C(b).isNotNull(), a, b) for a, b in pairs]
    one = df.groupBy(*by).agg(*[
        F.corr(F.when(ok, C(a)), F.when(ok, C(b))).alias(f"c{i}")
        for i, (ok, a, b) in enumerate(both)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"c{i}").alias("corr"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(*by, F.explode(cells).alias("p")).select(*by, "p.*")


def error_histogram(df: DataFrame, error: str = "err", width: float = 500.0) -> DataFrame:
    """Share of rows per error bin."""
    n = df.where(C(error).isNotNull()).groupBy(
        (F.floor(C(error) / F.lit(float(width))) * F.lit(float(width))).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return scalar_join(n, {"_all": F.sum("n")}).select(
        "bin", "n", (C("n") * 100.0 / C("_all")).alias("percent"))


def experiment_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Error shares, mean fit and run time, and bias quartiles per method or level."""
    base = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("fp").alias("fp_share"), F.avg("fn").alias("fn_share"),
        F.avg("nrmse").alias("nrmse_avg"), F.avg("time").alias("time_avg"))
    q = percentiles(results, by, "bias", {"bias_p25": 0.25, "bias_p50": 0.5, "bias_p75": 0.75})
    return base.join(q, list(by), "left")


def mean_count_benchmark(links: DataFrame, count: str = "count") -> DataFrame:
    """Constant prediction at the mean count and its sum of squared errors."""
    seen = links.where(C(count).isNotNull())
    out = scalar_join(seen, {"mean_count": F.avg(count)})
    return out.groupBy("mean_count").agg(F.sum(F.pow(C("mean_count") - C(count), 2)).alias("sse"))


def scale_min_max(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features mapped to [0, 1]; a constant feature becomes 0."""
    aggs = {}
    for f in features:
        aggs |= {f"_lo_{f}": F.min(f), f"_hi_{f}": F.max(f)}
    out = scalar_join(df, aggs)
    for f in features:
        out = out.withColumn(f, F.coalesce(F.try_divide(
            C(f) - C(f"_lo_{f}"), C(f"_hi_{f}") - C(f"_lo_{f}")),
            F.when(C(f).isNotNull(), F.lit(0.0))))
    return out.drop(*aggs)


def standardize(df: DataFrame, features: Sequence[str], center: bool = True,
                spread: bool = True) -> DataFrame:
    aggs = {}
    for f in features:
        aggs |= {f"_m_{f}": F.avg(f), f"_s_{f}": F.stddev_pop(f)}
    out = scalar_join(df, aggs)
    for f in features:
        x = C(f) - C(f"_m_{f}") if center else C(f)
        out = out.withColumn(f, F.try_divide(x, C(f"_s_{f}")) if spread else x)
    return out.drop(*aggs)


def nonzero_by_choice_set(df: DataFrame, value: str) -> DataFrame:
    """Nonzero values of the paths of each OD, one row per value."""
    return df.where(C(value) != 0).select("o", "d", "path_id", value)


def feature_entries(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Nonzero cells of a feature matrix as rows (key, feature, value)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), C(f).cast("double").alias("value"))
                      for f in features])
    return df.select(*key, F.explode(cells).alias("c")).select(*key, "c.*").where(C("value") != 0)


def feature_vectors(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One array of features per row, in the given order."""
    return df.select(*key, F.array(*[C(f).cast("double") for f in features]).alias("z"))


# ordering, sampling by rank ------------------------------------------------------------

def cumulative_demand(od: DataFrame) -> DataFrame:
    """OD pairs by falling demand with running trips and their share of all trips."""
    out = ranked(od.where(C("q") != 0), [], [C("q").desc(), C("o"), C("d")], "rank",
                 sums={"cum_q": "q"})
    out = scalar_join(out, {"_all": F.sum("q")})
    return out.withColumn("cum_share", C("cum_q") / C("_all") * 100).drop("_all")


def sample_by_demand(od: DataFrame, proportion: float, block: int = 0) -> DataFrame:
    """The ``block``-th group of ceil(proportion * n) OD pairs by falling demand.

    Block numbers past the last whole group start over.
    """
    out = ranked(od.where(C("q") != 0), [], [C("q").desc(), C("o"), C("d")], "_pos")
    out = scalar_join(out, {"_n": F.count(F.lit(1))})
    size = F.ceil(F.lit(float(proportion)) * C("_n"))
    start = F.lit(block) % F.floor(C("_n") / size) * size
    return out.where((C("_pos") > start) & (C("_pos") <= start + size)).drop("_pos", "_n")


def sequential_keys(nodes: DataFrame, node_id: str = "id", out: str = "key") -> DataFrame:
    """0-based keys in id order."""
    return ranked(nodes, [], [C(node_id)], out).withColumn(out, C(out) - 1)


def best_iteration(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Iteration with the lowest objective, the first one on ties."""
    top = log.groupBy(*by).agg(F.min(F.struct("objective", "iter")).alias("_b"))
    return top.select(*by, C("_b.iter").alias("iter"), C("_b.objective").alias("objective"))


def lowest_share(df: DataFrame, value: str, percent: float, key: Sequence[str]) -> DataFrame:
    """The floor(n * percent / 100) rows with the lowest ``value``."""
    out = ranked(df, [], [C(value), *[C(k) for k in key]], "_pos")
    out = scalar_join(out, {"_n": F.count(F.lit(1))})
    return out.where(C("_pos") <= F.floor(C("_n") * F.lit(float(percent)) / 100)).drop("_pos", "_n")


def first_decrease(scan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step of a line search before the objective first fails to rise."""
    from ..scale import lagged
    out = lagged(scan, by, [C("step")], {"_prev": ("objective", 1)})
    stop = out.groupBy(*by).agg(F.min(F.when(C("objective") <= C("_prev"), C("step"))).alias("_stop"))
    joined = (out.join(stop, list(by)) if by else scalar_join(
        out, {"_stop": F.min("_stop")}, stop))
    kept = joined.where(C("_stop").isNull() | (C("step") < C("_stop")))
    best = kept.groupBy(*by).agg(F.max(F.struct("step", "objective")).alias("_b"))
    return best.select(*by, "_b.*")


def random_links(links: DataFrame, n: int, seed: int = 0, key: Sequence[str] = LINK,
                 weights: Sequence[int] | None = None) -> DataFrame:
    """``n`` links in a repeatable random order of their keys."""
    from .sampling import pick_order
    pick = links.select(*key).distinct().withColumn("_h", pick_order(key, seed, weights))
    return pick.orderBy("_h", *key).limit(n).drop("_h")
