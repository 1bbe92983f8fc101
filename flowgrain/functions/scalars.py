"""Column expressions on links, times and parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import scalar_join

# Unit factor and tolerances that results depend on.
KM_TO_MILES = 0.62137119223
TINY_FLOW = 1e-12
CAPACITY_SHOWN = 10000.0

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Col, b: Col) -> Column:
    """Division that yields NULL, never an error, on a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def bpr_time(x: Col, tf: Col = "tf", k: Col = "k", alpha: Col = "alpha",
             beta: Col = "beta") -> Column:
    """Travel time of a link carrying flow ``x``."""
    return _c(tf) * (F.lit(1.0) + _c(alpha) * F.pow(ratio(x, k), _c(beta)))


def bpr_integral(x: Col, tf: Col = "tf", k: Col = "k", alpha: Col = "alpha",
                 beta: Col = "beta", constant_term: bool = False) -> Column:
    """Integral of the travel time from 0 to ``x``.

    ``constant_term`` keeps a 1 where the true integral has ``x``.
    """
    power = F.pow(ratio(x, k), _c(beta)) * _c(x)
    head = F.lit(1.0) if constant_term else _c(x)
    return _c(tf) * (head + _c(alpha) / (_c(beta) + F.lit(1.0)) * power)


def quadrature(fn: Callable[[Col], Column], nodes: int = 12) -> Callable[[Col], Column]:
    """Integral of ``fn`` from 0 to its argument as a Gauss sum, exact for polynomials of degree
    below twice the number of nodes."""
    places, weights = np.polynomial.legendre.leggauss(nodes)

    def integral(x: Col) -> Column:
        half = _c(x) / F.lit(2.0)
        terms = [F.lit(float(w)) * fn(half * F.lit(1.0 + float(p))) for p, w in zip(places, weights, strict=True)]
        return half * sum(terms[1:], terms[0])
    return integral


@dataclass(frozen=True)
class Performance:
    """Travel time of a link as a function of its flow, and the integral of it from 0."""

    time: Callable[[Col], Column]
    integral: Callable[[Col], Column]

    def __call__(self, x: Col) -> Column:
        return self.time(x)


def performance(fn: Callable[[Col], Column] | Performance | None = None,
                integral: Callable[[Col], Column] | None = None) -> Performance:
    """Slot for the link travel-time function: any callable from flow column to column. The
    integral may be given in closed form; otherwise it is a Gauss sum."""
    if isinstance(fn, Performance):
        return fn
    return Performance(fn, integral or quadrature(fn)) if fn else Performance(bpr_time, bpr_integral)


def entropy(f: Col) -> Column:
    return almost_zero(f, TINY_FLOW) * F.log(_c(f) + F.lit(TINY_FLOW))


def km_to_miles(x: Col) -> Column:
    return _c(x) * F.lit(KM_TO_MILES)


def feed_time(x: Col) -> Column:
    """Clock text of the count feed; unreadable text becomes NULL."""
    return F.try_to_timestamp(_c(x), F.lit("MM/dd/yyyy HH:mm:ss"))


def text_flag(x: Col, truth: str = "T") -> Column:
    return F.when(_c(x) == truth, 1).otherwise(0)


def free_flow_time(length: Col, speed: Col, factor: float = 60.0,
                   fallback: Col | None = None) -> Column:
    t = ratio(F.lit(float(factor)) * _c(length), speed)
    return t if fallback is None else F.coalesce(t, _c(fallback))


def capacity_divisor(count: Col, capacity: Col) -> Column:
    """Smallest integer that brings a count down to its capacity; NULL if there is none."""
    return F.when(_c(count).isNotNull() & (_c(capacity) > 0),
                  F.greatest(F.lit(1.0), F.ceil(_c(count) / _c(capacity)).cast("double")))


def congestion_index(predicted: Col, capacity: Col) -> Column:
    return F.round(F.least(ratio(predicted, capacity), F.lit(1.0)), 4)


def shown_capacity(k: Col) -> Column:
    return F.when(_c(k) > CAPACITY_SHOWN, F.lit(float("inf"))).otherwise(_c(k))


def average_speed(length: Col, time: Col) -> Column:
    return F.round(ratio(F.lit(60.0) * _c(length), time), 1)


def as_number(x: Col) -> Column:
    return _c(x).try_cast("double")


def clean_text(x: Col) -> Column:
    return F.lower(F.trim(_c(x)))


def is_digits(x: Col) -> Column:
    return _c(x).rlike(r"^\d+$")


def link_label(u: Col, v: Col, idx: Col | None = None, shift: int = 0) -> Column:
    """Key text ``(u, v, 'idx')``, or ``(u, v)`` without an index; ``shift`` renumbers."""
    a, b = _c(u) + F.lit(shift), _c(v) + F.lit(shift)
    if idx is None:
        return F.format_string("(%d, %d)", a, b)
    return F.format_string("(%d, %d, '%s')", a, b, _c(idx))


def interval_label(center: Col, half_width: Col) -> Column:
    lo, hi = _c(center) - _c(half_width), _c(center) + _c(half_width)
    return F.format_string("[%.3f, %.3f]", F.round(lo, 3), F.round(hi, 3))


def value_of_time(theta_tt: Col, theta_c: Col) -> Column:
    return ratio(theta_tt, theta_c)


def soft_threshold(theta: Col, lam: Col | float) -> Column:
    lam = _c(lam) if isinstance(lam, (str, Column)) else F.lit(float(lam))
    return F.signum(_c(theta)) * F.greatest(F.abs(_c(theta)) - lam, F.lit(0.0))


def almost_zero(x: Col, tol: float) -> Column:
    return F.when(F.abs(_c(x)) < tol, F.lit(0.0)).otherwise(_c(x))


def no_zeros(x: Col, tol: float) -> Column:
    return F.when(F.abs(_c(x)) < tol, F.lit(float(tol))).otherwise(_c(x))


def nonnegative_weight(df: DataFrame, utility: str, out: str = "weight") -> DataFrame:
    """Edge cost ``-utility``, lifted by the size of its minimum so none is negative."""
    lifted = scalar_join(df, {"_low": F.min(-F.col(utility))})
    return lifted.withColumn(out, F.abs("_low") - F.col(utility)).drop("_low")


def linear_utility(theta: Mapping[str, float]) -> Column:
    """Weighted sum of feature columns; features with no weight are left out."""
    total = F.lit(0.0)
    for name, weight in theta.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def shared_features(theta: Mapping[str, float], df: DataFrame) -> dict[str, float]:
    """Weights whose feature exists as a column of ``df``."""
    have = set(df.columns)
    return {k: w for k, w in theta.items() if k in have}


def engineer_features(links: DataFrame, regular: str = "LWRLK",
                      quartile_of: Sequence[str] = ("median_inc", "tt_cv", "speed_sd"),
                      regular_only: bool = True) -> DataFrame:
    """Reliability, length products and 0/1 features, then lowest-quartile dummies."""
    from ..scale import percentiles

    def flag(source: str, yes: str, no: str, df: DataFrame) -> DataFrame:
        hit = F.when(F.col(source) > 0, 1).otherwise(0)
        return df.withColumn(yes, hit).withColumn(no, 1 - hit)

    out = (links
           .withColumn("tt_sd_adj", F.col("tf") * F.col("tt_cv"))
           .withColumn("speed_sd_length", F.col("length") * F.col("speed_sd"))
           .withColumn("speed_reliability",
                       F.when(F.col("speed_ref_avg") != 0,
                              ratio("speed_hist_avg", "speed_ref_avg")).otherwise(F.lit(0.0)))
           .withColumn("tt_avg_adj",
                       F.when(F.col("speed_ref_avg") != 0, ratio("length", "speed_avg"))
                       .otherwise(F.col("tf")))
           .withColumn("median_inc_length", F.col("length") * F.col("median_inc")))
    for source, yes, no in (("incidents", "incident", "no_incidents"),
                            ("bus_stops", "bus_stop", "no_bus_stops"),
                            ("intersections", "intersection", "no_intersections")):
        out = flag(source, yes, no, out)
    is_regular = F.col("link_type") == regular
    out = scalar_join(out, {"_m_sd": F.avg("speed_sd"), "_m_avg": F.avg("speed_avg")},
                      out.where(is_regular))
    for name, mean in (("speed_sd", "_m_sd"), ("speed_avg", "_m_avg")):
        out = out.withColumn(name, F.when(is_regular & (F.col(name) == 0), F.col(mean))
                             .otherwise(F.col(name)))
    out = out.drop("_m_sd", "_m_avg")
    # the quartiles of all features come from one pass over their values
    values = F.array(*[F.struct(F.lit(n).alias("_f"), F.col(n).cast("double").alias("_x"))
                       for n in quartile_of])
    long = out.where(is_regular).select(F.explode(values).alias("_p")).select("_p.*")
    cuts = percentiles(long, ["_f"], "_x", {"_q": 0.25})
    out = scalar_join(out, {f"_q_{n}": F.max(F.when(F.col("_f") == n, F.col("_q")))
                            for n in quartile_of}, cuts)
    names = {"median_inc": ("low_inc", "high_inc"), "tt_cv": ("reliable_tt", "unreliable_tt"),
             "speed_sd": ("reliable_speed", "unreliable_speed")}
    for source in quartile_of:
        low, high = names[source]
        hit = F.when(F.col(source) <= F.col(f"_q_{source}"), 1).otherwise(0)
        out = out.withColumn(low, hit).withColumn(high, 1 - hit).drop(f"_q_{source}")
    if regular_only:
        for name in [n for n in out.columns if n not in links.columns]:
            out = out.withColumn(name, F.when(is_regular, F.col(name)).otherwise(0))
    return out
