"""Report tables: wide iteration tables, convergence, experiment results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import average_speed, bpr_time, shown_capacity
from .joins import with_true_values

C = F.col
KEY = ["u", "v"]


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns a frame lacks become NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def stages(**frames: DataFrame) -> DataFrame:
    """Union of stage tables with the stage name in front."""
    named = [df.select(F.lit(name).alias("stage"), "*") for name, df in frames.items()]
    return union_all(*named)


def difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def by_iteration(log: DataFrame, value: str, iters: Sequence[int], key: Sequence[str] = KEY
                 ) -> DataFrame:
    """One column ``iter_i`` per listed iteration."""
    return log.groupBy(*key).agg(*[
        F.max(F.when(C("iter") == i, C(value))).alias(f"iter_{i}") for i in iters])


def predicted_by_iteration(log: DataFrame, links: DataFrame, iters: Sequence[int],
                           gap: bool = False) -> DataFrame:
    """Predicted flows by iteration with observed flag and true count; ``gap`` subtracts it."""
    wide = by_iteration(log, "x", iters)
    true = links.select(*KEY, C("count").isNotNull().cast("int").alias("observed"),
                        C("count").alias("true_count"))
    out = wide.join(true, KEY, "left")
    if gap:
        for i in iters:
            out = out.withColumn(f"iter_{i}", C(f"iter_{i}") - C("true_count"))
    return out


def convergence_table(norefined: DataFrame, refined: DataFrame, features: Sequence[str]
                      ) -> DataFrame:
    """Both stages in one table, iterations numbered on, value of time added.

    Inputs have iter, parameter, est, objective, n_paths.
    """
    def wide(df: DataFrame) -> DataFrame:
        return df.groupBy("iter").agg(
            *[F.max(F.when(C("parameter") == f, C("est"))).alias(f"theta_{f}") for f in features],
            F.max("objective").alias("objective"), F.max("n_paths").alias("n_paths"))
    first, second = wide(norefined), wide(refined)
    from ..scale import scalar_join
    second = scalar_join(second, {"_last": F.max("iter")}, norefined)
    second = second.withColumn("iter", C("iter") + C("_last")).drop("_last")
    out = stages(norefined=first, refined=second)
    vot = (F.try_divide("theta_tt", "theta_c") if "c" in features
           else F.try_divide("theta_tt", "theta_tt_sd") if "tt_sd" in features
           else F.lit(None).cast("double"))
    return out.withColumn("vot", vot)


def estimate_gaps(convergence: DataFrame, truth: Mapping[str, float]) -> DataFrame:
    """Distance of each estimate (and the value of time) to its true value."""
    out = convergence.drop("objective")
    for name, value in truth.items():
        if f"theta_{name}" in out.columns:
            out = (out.withColumn(f"gap_theta_{name}", C(f"theta_{name}") - F.lit(float(value)))
                   .drop(f"theta_{name}"))
    if "vot" in out.columns and truth.get("c"):
        out = out.withColumn("gap_vot", C("vot") - F.lit(truth["tt"] / truth["c"])).drop("vot")
    return out


def link_summary(links: DataFrame) -> DataFrame:
    return links.select(*KEY, "link_type", "length", "tf", shown_capacity("k").alias("capacity"),
                        "alpha", "beta", "count")


def link_report(links: DataFrame, flows: DataFrame) -> DataFrame:
    """Observed links with capacity, time, speed, count, prediction and error."""
    seen = links.where(C("count").isNotNull())
    both = seen.join(flows.select(*KEY, "x"), KEY)
    t = bpr_time("x")
    return both.select(
        *KEY, shown_capacity("k").alias("capacity"), t.alias("tt"),
        average_speed("length", t).alias("speed"), "count", C("x").alias("predicted"),
        (C("x") - C("count")).alias("error"))


def od_matrix(od: DataFrame, destinations: Sequence[int] | None = None) -> DataFrame:
    """Demand with origins as rows and destinations as columns: those listed, or all of the
    table. A column each is the feature, so their number is that of the zones."""
    if destinations is None:
        destinations = sorted(r["d"] for r in od.select("d").where("d is not null").distinct().collect())
    return od.groupBy("o").agg(*[
        F.coalesce(F.sum(F.when(C("d") == j, C("q"))), F.lit(0.0)).alias(f"d{j}")
        for j in destinations])


def monotonicity(grid_flows: DataFrame, thetas: Sequence[float], key: Sequence[str] = KEY
                 ) -> DataFrame:
    """Link flows at each grid value as columns t0, t1, …"""
    return grid_flows.groupBy(*key).agg(*[
        F.max(F.when(C("theta") == F.lit(float(t)), C("x"))).alias(f"t{i}")
        for i, t in enumerate(thetas)])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def test_flags(results: DataFrame, truth: Mapping[str, float], h0: float = 0.0,
               alpha: float = 0.05) -> DataFrame:
    """Bias and false-positive / false-negative flags of each tested parameter."""
    truth = dict(truth)
    if truth.get("c"):
        truth["vot"] = truth["tt"] / truth["c"]
    out = with_true_values(results, truth).withColumn("bias", C("est") - C("theta_true"))
    null_true = F.coalesce(C("theta_true") == F.lit(float(h0)), F.lit(False))
    p = C("p_value")
    return (out.withColumn("f_type", F.when(null_true, "fp").otherwise("fn"))
            .withColumn("fp", F.when(null_true & (p < alpha), 1).otherwise(0))
            .withColumn("fn", F.when(~null_true & (p > alpha), 1).otherwise(0)))


def scatter_sample(df: DataFrame, key: str, fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """Share of rows without replacement, by a hash of ``key`` and ``seed``: a row is in or out
    whatever the partitions, and again when a task is repeated. Rows without a key are left out."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), C(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.where(C(key).isNotNull() & (draw < F.lit(int(fraction * (1 << 32)))))
