"""Imputation, sampling, noise."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import percentiles, ranked, scalar_join
from .filters import REGULAR

C = F.col


def trim_impute(links: DataFrame, feature: str, low: float = 1.0, high: float = 99.0,
                regular_only: bool = True) -> DataFrame:
    """Values outside the two percentiles become the mean of the values inside."""
    scope = C("link_type") == REGULAR if regular_only else F.lit(True)
    base = links.where(scope)
    cut = percentiles(base, [], feature, {"_lo": low / 100.0, "_hi": high / 100.0})
    out = scalar_join(links, {"_lo": F.first("_lo"), "_hi": F.first("_hi")}, cut)
    inside = (C(feature) >= C("_lo")) & (C(feature) <= C("_hi"))
    out = scalar_join(out, {"_mean": F.avg(F.when(inside, C(feature)))}, out.where(scope))
    fixed = F.when(scope & ~inside, C("_mean")).otherwise(C(feature))
    return out.withColumn(feature, fixed).drop("_lo", "_hi", "_mean")


def zero_to_mean(links: DataFrame, features: Sequence[str]) -> DataFrame:
    """On regular links a 0 means missing and takes the mean of regular links, zeros included."""
    is_regular = C("link_type") == REGULAR
    out = scalar_join(links, {f"_m_{f}": F.avg(f) for f in features}, links.where(is_regular))
    for f in features:
        out = out.withColumn(f, F.when(is_regular & (C(f) == 0), C(f"_m_{f}")).otherwise(C(f)))
    return out.drop(*[f"_m_{f}" for f in features])


def missing_to_mean(df: DataFrame, features: Sequence[str], source: DataFrame | None = None
                    ) -> DataFrame:
    out = scalar_join(df, {f"_m_{f}": F.avg(f) for f in features}, source)
    for f in features:
        out = out.withColumn(f, F.coalesce(f, f"_m_{f}"))
    return out.drop(*[f"_m_{f}" for f in features])


def fill_defaults(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, list(features))


def pick_order(key: Sequence[str], seed: int = 0, weights: Sequence[int] | None = None) -> Column:
    """Repeatable random order of rows by key.

    With ``weights`` the order is an arithmetic hash of integer keys, the same in any
    SQL engine; otherwise a 64-bit hash.
    """
    if weights is None:
        return F.xxhash64(*key, F.lit(seed))
    mixed = sum((C(k).cast("long") * F.lit(w) for k, w in zip(key, weights)), F.lit(seed))
    return F.pmod(mixed * F.lit(7919), F.lit(1000003))


def random_share(df: DataFrame, key: Sequence[str], share: float, seed: int = 0,
                 weights: Sequence[int] | None = None, mark: str | None = None) -> DataFrame:
    """floor(share * n) rows without replacement; ``mark`` flags them instead of filtering."""
    rank = ranked(df.withColumn("_h", pick_order(key, seed, weights)), [],
                  [C("_h"), *[C(k) for k in key]], "_pos")
    rank = scalar_join(rank, {"_n": F.count(F.lit(1))})
    hit = C("_pos") <= F.floor(F.lit(float(share)) * C("_n"))
    rank = rank.withColumn(mark, hit.cast("int")) if mark else rank.where(hit)
    return rank.drop("_h", "_pos", "_n")


def mask_by_coverage(links: DataFrame, key: Sequence[str], coverage: float, seed: int = 0,
                     weights: Sequence[int] | None = None) -> DataFrame:
    """Hide n - floor(n * coverage) counts; the hidden ones go to ``withdrawn``."""
    rank = ranked(links.withColumn("_h", pick_order(key, seed, weights)), [],
                  [C("_h"), *[C(k) for k in key]], "_pos")
    rank = scalar_join(rank, {"_n": F.count(F.lit(1))})
    hidden = C("_pos") <= C("_n") - F.floor(C("_n") * F.lit(float(coverage)))
    return (rank.withColumn("withdrawn", F.when(hidden, C("count")))
            .withColumn("count", F.when(~hidden, C("count"))).drop("_h", "_pos", "_n"))


def split_counts(links: DataFrame, key: Sequence[str], training: float, seed: int = 0,
                 weights: Sequence[int] | None = None) -> DataFrame:
    """Observed links marked as training (first floor(p * n)) or validation."""
    seen = random_share(links.where(C("count").isNotNull()), key, training, seed, weights, "_t")
    return seen.withColumn("sample", F.when(C("_t") == 1, "training").otherwise("validation")
                           ).drop("_t")


def noisy_counts(links: DataFrame, mu: float = 0.0, sd: float = 0.0, snr: float = 0.0,
                 seed: int = 0) -> DataFrame:
    """Counts with normal noise, no lower than 0.

    The spread is a share of the mean count, or follows from a signal-to-noise ratio.
    """
    if not (mu or sd or snr):
        return links
    out = scalar_join(links, {"_m": F.avg("count"), "_v": F.var_pop("count")})
    spread = F.sqrt(C("_v") / F.lit(float(snr))) if snr else C("_m") * F.lit(float(sd))
    noisy = C("count") + F.lit(float(mu)) + spread * normal(["u", "v"], seed)
    return out.withColumn("count", F.greatest(F.lit(0.0), noisy)).drop("_m", "_v")


def uniform(key: Sequence[str], seed: int) -> Column:
    """Repeatable uniform draw in (0, 1) from a key; a retried task draws the same."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal(key: Sequence[str], seed: int) -> Column:
    """Repeatable standard normal draw from a key."""
    a, b = uniform(key, 2 * seed), uniform(key, 2 * seed + 1)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * F.pi() * b)


@F.pandas_udf(T.DoubleType())
def _poisson(mean: pd.Series, seed: pd.Series) -> pd.Series:
    import numpy as np
    return pd.Series([float(np.random.default_rng(int(s)).poisson(m))
                      for m, s in zip(mean, seed)])


def noisy_demand(od: DataFrame, sd: float | str, seed: int = 0) -> DataFrame:
    """Demand with normal noise (share of its value, floor 1e-7) or Poisson draws."""
    if sd == "poisson":
        s = F.pmod(F.xxhash64("o", "d", F.lit(seed)), F.lit(1 << 62))
        return od.withColumn("q", _poisson(C("q"), s))
    noisy = C("q") + C("q") * F.lit(float(sd)) * normal(["o", "d"], seed)
    return od.withColumn("q", F.greatest(F.lit(1e-7), noisy))


def random_features(links: DataFrame, names: Sequence[str], low: float, high: float,
                    seed: int = 0, integer: bool = False) -> DataFrame:
    for i, name in enumerate(names):
        draw = uniform(["u", "v"], seed + i) * F.lit(float(high - low)) + F.lit(float(low))
        links = links.withColumn(name, F.floor(draw).cast("double") if integer else draw)
    return links


# The five link classes: free-flow times; alpha, beta and capacity are shared. Fixed values.
CLASS_TF = (0.2, 0.4, 0.6, 0.8, 1.0)
CLASS_ALPHA, CLASS_BETA, CLASS_K = 0.15, 4.0, 1800.0


def random_bpr(links: DataFrame, seed: int = 0, key: Sequence[str] = ("u", "v"),
               weights: Sequence[int] | None = None) -> DataFrame:
    pick = F.pmod(pick_order(key, seed, weights), F.lit(len(CLASS_TF))).cast("int") + 1
    return links.withColumns({
        "tf": F.element_at(F.array(*[F.lit(t) for t in CLASS_TF]), pick),
        "alpha": F.lit(CLASS_ALPHA), "beta": F.lit(CLASS_BETA), "k": F.lit(CLASS_K)})
