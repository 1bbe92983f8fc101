"""Error metrics of predictions, by name and by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import group_join, lagged, percentiles, same_keys, scalar_join
from ..session import pin

# Fixed value: keeps denominators away from zero.
EPS = 1e-10

def _a() -> Column:
    return F.col("actual")


def _p() -> Column:
    return F.col("predicted")


def _b() -> Column:
    return F.col("_bench")


def _e() -> Column:
    return _a() - _p()


def _geomean(x: Column) -> Column:
    """Geometric mean; any zero makes it zero."""
    return F.when(F.min(x) == 0, F.lit(0.0)).otherwise(
        F.exp(F.avg(F.log(F.when(x > 0, x)))))


def _pe() -> Column:
    return _e() / (_a() + EPS)


def _smape() -> Column:
    return 2 * F.abs(_e()) / (F.abs(_a()) + F.abs(_p()) + EPS)


def _re() -> Column:
    return F.when(_b().isNotNull(), _e() / (_a() - _b() + EPS))


def _bre() -> Column:
    return F.when(_b().isNotNull(), F.abs(_e()) / (F.abs(_e()) + F.abs(_a() - _b()) + EPS))


def _sse_ratio() -> Column:
    return F.sqrt(F.try_divide(F.sum(_e() * _e()), F.sum(F.pow(_a() - F.col("_abar"), 2))))


def _naive_mae() -> Column:
    return F.avg(F.abs(_a() - F.col("_lag_a")))


def _centered(x: Column, center: str) -> Column:
    return F.sqrt(F.try_divide(F.sum(F.pow(x - F.col(center), 2)), F.count(x) - 1))


# Plain aggregates over rows (one pass).
SIMPLE: dict[str, Callable[[], Column]] = {
    "mse": lambda: F.avg(_e() * _e()),
    "rmse": lambda: F.sqrt(F.avg(_e() * _e())),
    "nrmse": lambda: F.try_divide(F.sqrt(F.avg(_e() * _e())), F.avg(_a())),
    "me": lambda: F.avg(_e()),
    "mae": lambda: F.avg(F.abs(_e())),
    "mad": lambda: F.avg(F.abs(_e())),
    "gmae": lambda: _geomean(F.abs(_e())),
    "mpe": lambda: F.avg(_pe()),
    "mape": lambda: F.avg(F.abs(_pe())),
    "smape": lambda: F.avg(_smape()),
    "maape": lambda: F.avg(F.atan(F.abs(_pe()))),
    "rmspe": lambda: F.sqrt(F.avg(_pe() * _pe())),
}
# Aggregates around a group mean found in a first pass (columns _abar, _mae, _mape).
CENTERED: dict[str, Callable[[], Column]] = {
    "std_ae": lambda: _centered(_e(), "_mae"),
    "std_ape": lambda: _centered(_pe(), "_mape"),
    "inrse": _sse_ratio,
    "rrse": _sse_ratio,
    "rae": lambda: F.sum(F.abs(_e())) / (F.sum(F.abs(_a() - F.col("_abar"))) + EPS),
}
# Aggregates that look at an earlier row of the series or at a benchmark.
ORDERED: dict[str, Callable[[], Column]] = {
    "mase": lambda: F.try_divide(F.avg(F.abs(_e())), _naive_mae()),
    "rmsse": lambda: F.try_divide(F.sqrt(F.avg(_e() * _e())), _naive_mae()),
    "mre": lambda: F.avg(_re()),
    "mrae": lambda: F.avg(F.abs(_re())),
    "gmrae": lambda: _geomean(F.abs(_re())),
    "mbrae": lambda: F.avg(_bre()),
    "umbrae": lambda: F.try_divide(F.avg(_bre()), 1 - F.avg(_bre())),
    "mda": lambda: F.avg(F.when(F.col("_step_a").isNotNull(),
                                (F.signum(_a() - F.col("_step_a")) == F.signum(_p() - F.col("_step_p")))
                                .cast("double"))),
}
# Medians: the row expression, and what is done to its median.
MEDIAN: dict[str, tuple[Callable[[], Column], Callable[[Column], Column]]] = {
    "mdae": (lambda: F.abs(_e()), lambda m: m),
    "mdape": (lambda: F.abs(_pe()), lambda m: m),
    "smdape": (_smape, lambda m: m),
    "rmdspe": (lambda: _pe() * _pe(), F.sqrt),
    "mdrae": (lambda: F.abs(_re()), lambda m: m),
}


def metric_names() -> tuple[str, ...]:
    return (*SIMPLE, *CENTERED, *ORDERED, *MEDIAN)


def register_metric(name: str, aggregate: Callable[[], Column]) -> None:
    """Add a metric: a builder of an aggregate over ``actual`` and ``predicted``."""
    SIMPLE[name] = aggregate


def evaluate(df: DataFrame, metrics: Sequence[str] = ("mse", "rmse", "nrmse", "mae"),
             by: Sequence[str] = (), order: Sequence[Column] | None = None,
             seasonality: int = 1, benchmark: str | None = None) -> DataFrame:
    """One row per ``by`` group with one column per metric.

    ``df`` has ``actual`` and ``predicted``; rows without an actual value are dropped.
    Metrics against earlier rows need ``order``. All plain metrics come from one
    aggregation; a metric that cannot be computed is NULL.
    """
    unknown = [m for m in metrics if m not in metric_names()]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    by = list(by)
    rows = df.where(_a().isNotNull())
    if any(m not in SIMPLE for m in metrics):
        # several passes follow (group sizes, lags, medians); the feed is read once for all
        rows = pin(rows)
    needs_order = [m for m in metrics if m in ORDERED or m == "mdrae"]
    if needs_order:
        lags = {"_step_a": ("actual", 1), "_step_p": ("predicted", 1),
                "_lag_a": ("actual", seasonality)}
        if order is None:
            raise ValueError(f"{needs_order} need an order")
        rows = lagged(rows, by, list(order), lags)
        rows = rows.withColumn("_bench", F.col(benchmark) if benchmark else F.col("_lag_a"))
    if any(m in CENTERED for m in metrics):
        means = {"_abar": F.avg(_a()), "_mae": F.avg(F.abs(_e())), "_mape": F.avg(F.abs(_pe()))}
        if by:
            rows = group_join(rows, by, means)
        else:
            rows = scalar_join(rows, means)
    exprs = []
    for table in (SIMPLE, CENTERED, ORDERED):
        exprs += [table[m]().alias(m) for m in metrics if m in table]
    out = rows.groupBy(*by).agg(*(exprs or [F.count(F.lit(1)).alias("_n")]))
    key = by or ["_one"]
    if not by:
        out = out.withColumn("_one", F.lit(1))
    # medians of all requested expressions come from one ranked long table
    wanted = [m for m in metrics if m in MEDIAN]
    if wanted:
        pairs = F.array(*[F.struct(F.lit(m).alias("_m"), MEDIAN[m][0]().alias("_x"))
                          for m in wanted])
        long = rows.select(*by, F.explode(pairs).alias("_p")).select(
            *by, F.col("_p._m").alias("_m"), F.col("_p._x").alias("_x"))
        med = percentiles(long, [*by, "_m"], "_x", {"_q": 0.5})
        wide = med.groupBy(*by).agg(*[MEDIAN[m][1](F.max(F.when(F.col("_m") == m, F.col("_q"))))
                                      .alias(m) for m in wanted])
        if not by:
            wide = wide.withColumn("_one", F.lit(1))
        out = same_keys(out, wide, [key] if isinstance(key, str) else list(key), "left")
    return out.select(*by, *metrics)
