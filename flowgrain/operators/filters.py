"""Row and value filters on feeds, links, paths and parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lagged, lookup

# Fixed value: type code of a regular road link; all others are connectors.
REGULAR = "LWRLK"
LINK = ["u", "v", "idx"]

PARTS = {"year": F.year, "month": F.month, "day_month": F.dayofmonth, "day_week": F.dayofweek}
CLOCK = {"hour": F.hour, "minute": F.minute}


def date_parts(df: DataFrame, ts: str = "ts", day: str | None = None) -> DataFrame:
    """Add year, month, day_month, day_week (Sunday = 1), hour and minute.

    Dates may come from another column than clock times (local date, UTC clock).
    """
    for name, fn in PARTS.items():
        df = df.withColumn(name, fn(day or ts))
    for name, fn in CLOCK.items():
        df = df.withColumn(name, fn(ts))
    return df


def select_period(date: str, hour: int | Sequence[int]) -> dict[str, object]:
    """Period of one calendar day and hour, in the numbering of ``date_parts``."""
    d = dt.date.fromisoformat(date)
    return {"year": d.year, "month": d.month, "day_month": d.day,
            "day_week": d.isoweekday() % 7 + 1, "hour": hour}


def period_filter(df: DataFrame, period: Mapping[str, object],
                  partition_date: str | None = None) -> DataFrame:
    """Keep rows whose date parts are among the given values; absent parts do not filter.

    When the period fixes one whole date, ``partition_date`` also gets an equality so
    that day partitions are pruned.
    """
    for part in (*PARTS, *CLOCK):
        if part in period:
            want = period[part]
            values = list(want) if isinstance(want, (list, tuple, set, range)) else [want]
            df = df.where(F.col(part).isin(values))
    if partition_date and all(isinstance(period.get(k), int)
                              for k in ("year", "month", "day_month")):
        day = dt.date(period["year"], period["month"], period["day_month"])
        df = df.where(F.col(partition_date) == F.lit(day))
    return df


def clock_interval(df: DataFrame, hour: int, minutes: int, ts: str = "ts",
                   compat: bool = False) -> DataFrame:
    """Rows of the ``minutes`` after ``hour`` o'clock, half open.

    ``compat`` keeps whole clock hours up to the last one, inclusive, and with a
    remainder only that last hour up to and including the remaining minutes.
    """
    if not compat:
        at = F.hour(ts) * 60 + F.minute(ts)
        return df.where((at >= hour * 60) & (at < hour * 60 + minutes))
    whole, rest = divmod(minutes, 60)
    out = df.where((F.hour(ts) >= hour) & (F.hour(ts) <= hour + whole))
    if rest:
        out = out.where((F.hour(ts) >= hour + whole) & (F.minute(ts) <= rest))
    return out


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def regular_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("link_type") == REGULAR)


def connector_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("link_type") != REGULAR)


def observed_links(links: DataFrame, count: str = "count") -> DataFrame:
    return links.where(F.col(count).isNotNull())


def clear_counts(links: DataFrame, keys: DataFrame, count: str = "count",
                 complement: bool = False, on: Sequence[str] = ("u", "v")) -> DataFrame:
    """Make the counts of listed links missing (``complement``: of all others)."""
    marked = links.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), list(on),
                        "left")
    hit = F.coalesce("_hit", F.lit(False))
    gone = ~hit if complement else hit
    return marked.withColumn(count, F.when(~gone, F.col(count))).drop("_hit")


def paths_per_link(paths: DataFrame) -> DataFrame:
    """Number of paths over each link some path uses."""
    seg = paths.select(F.explode("segs").alias("seg")).select("seg.*")
    return seg.groupBy(*LINK).agg(F.count(F.lit(1)).alias("n_paths"))


def mask_uncovered(links: DataFrame, paths: DataFrame, count: str = "count") -> DataFrame:
    """Counts on links without any path become missing; adds ``n_paths``."""
    out = links.join(paths_per_link(paths), LINK, "left")
    return (out.withColumn(count, F.when(F.col("n_paths").isNotNull(), F.col(count)))
            .withColumn("n_paths", F.coalesce("n_paths", F.lit(0))))


def informative_links(log: DataFrame, link: Sequence[str] = ("u", "v"), tol: float = 1e-10
                      ) -> DataFrame:
    """Links whose prediction error moves in some iteration of ``log`` (link, iter, err)."""
    step = lagged(log, link, [F.col("iter")], {"_prev": ("err", 1)})
    top = step.groupBy(*link).agg(F.max(F.col("err") - F.col("_prev")).alias("top_change"))
    return top.where(~(F.abs("top_change") <= tol))


def nonzero_od(od: DataFrame, q: str = "q") -> DataFrame:
    return od.where(F.col(q) != 0)


def sign_consistent(estimates: DataFrame, params: DataFrame) -> DataFrame:
    """Estimates whose sign agrees with the expected sign of their parameter."""
    both = lookup(estimates, params.select("parameter", "sign"), "parameter", "inner")
    return both.where(((F.col("est") > 0) & (F.col("sign") == "+"))
                      | ((F.col("est") < 0) & (F.col("sign") == "-")))


def select_features(links: DataFrame, features: Sequence[str], key: Sequence[str] = ("u", "v")
                    ) -> tuple[DataFrame, list[str]]:
    """Feature columns that exist, and the names of those that do not."""
    have = [f for f in features if f in links.columns]
    return links.select(*key, *have), [f for f in features if f not in have]


def zero_connectors(links: DataFrame, features: Sequence[str]) -> DataFrame:
    for name in features:
        links = links.withColumn(name, F.when(F.col("link_type") != REGULAR, F.lit(0.0))
                                 .otherwise(F.col(name)))
    return links


def in_box(x: str, y: str, box: tuple[float, float, float, float]) -> Column:
    """Strictly inside (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = map(float, box)
    return ((F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1))


def valid_link_id(text: str, sep: str = "-") -> Column:
    """True for two or three integer parts."""
    parts = F.split(F.col(text), sep)
    return F.size(parts).between(2, 3) & F.forall(
        parts, lambda p: p.try_cast("int").isNotNull())
