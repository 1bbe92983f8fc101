"""Route choice and assignment: utilities, probabilities, flows, equilibrium.

Feature sums of a path come from one pass over its links; probabilities need the OD's
log-sum, a partial aggregate joined back over (OD, salt); link flows explode the link array of each path and add up. All candidate weights or step sizes of
a search are columns of the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import almost_zero, entropy, linear_utility, performance
from ..operators.filters import LINK
from ..operators.network import OD, path_size_factors
from ..scale import lookup, salted_join
from ..session import bucketed, pin
from .generation import Generation, PathSet

C = F.col


def design_matrix(links: DataFrame, features: Sequence[str]) -> DataFrame:
    return links.select(*LINK, *[C(f).cast("double").alias(f) for f in features])


def link_utility(links: DataFrame, theta: Mapping[str, float], out: str = "v_link") -> DataFrame:
    return links.withColumn(out, linear_utility(theta))


def path_sums(paths: DataFrame, links: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sum of each feature over the links of a path: rows (path_id, o, d, features).

    The rows of a path come from one input row, so map-side sums leave one row per path.
    """
    hops = paths.select("path_id", *OD, F.explode("segs").alias("seg")).select(
        "path_id", *OD, "seg.*")
    hops = lookup(hops, links.select(*LINK, *features), LINK, "inner")
    return hops.groupBy("path_id", *OD).agg(*[F.sum(f).alias(f) for f in features])


def feature_sums(paths: DataFrame, links: DataFrame, features: Sequence[str],
                 known: DataFrame | None = None) -> DataFrame:
    """``path_sums`` that takes features found in ``known`` from there."""
    have = [f for f in features if known is not None and f in known.columns]
    missing = [f for f in features if f not in have]
    if not missing:
        return known.select("path_id", *OD, *have)
    new = path_sums(paths, links, missing)
    return new.join(known.select("path_id", *have), "path_id") if have else new


def path_utility(paths: DataFrame, links: DataFrame, theta: Mapping[str, float],
                 path_size: float = 0.0, known: DataFrame | None = None, out: str = "v"
                 ) -> DataFrame:
    """Utility of each path, with the path-size term when its factor is not 0.

    Rows are narrow (path_id, o, d, features, v): the link arrays stay in ``paths``.
    """
    df = feature_sums(paths, links, list(theta), known).withColumn(out, linear_utility(theta))
    if path_size:
        sizes = (known if known is not None and "path_size" in known.columns
                 else path_size_factors(paths)).select("path_id", "path_size")
        df = df.join(sizes, "path_id").withColumn(
            out, C(out) + F.lit(float(path_size)) * F.log("path_size"))
    return df


def utility_parts(paths: DataFrame, links: DataFrame, theta: Mapping[str, float],
                  endogenous: Sequence[str] = ("tt",), path_size: float = 0.0) -> DataFrame:
    """Utility of each path split in flow-dependent, exogenous and path-specific parts."""
    y = {k: w for k, w in theta.items() if k in endogenous}
    z = {k: w for k, w in theta.items() if k not in endogenous}
    df = path_sums(paths, links, list(theta))
    df = df.withColumn("v_y", linear_utility(y)).withColumn("v_z", linear_utility(z))
    sizes = path_size_factors(paths).select("path_id", "path_size")
    return df.join(sizes, "path_id").withColumn(
        "v_path", F.lit(float(path_size)) * F.log("path_size"))


def od_join(paths: DataFrame, dim: DataFrame, stored: bool = False) -> DataFrame:
    """Add one-row-per-OD columns; a hot OD's paths spread over salted tasks. With ``stored``,
    for paths that are, ``dim`` is written first, so that a small one moves no paths."""
    return lookup(paths, pin(dim), OD, "inner") if stored else salted_join(paths, dim, OD)


def normalize(paths: DataFrame, v: str = "v", out: str = "v_norm") -> DataFrame:
    """Utility minus the maximum of the choice set."""
    top = paths.groupBy(*OD).agg(F.max(v).alias("_top"))
    return od_join(paths, top).withColumn(out, C(v) - C("_top")).drop("_top")


def choice_moments(paths: DataFrame, outs: Mapping[str, str], features: Sequence[str] = (),
                   second: bool = False, stored: bool = False) -> DataFrame:
    """One row per OD: the log-sum of each utility column, and means (and variances) of
    path features under the probabilities it gives.

    ``outs`` maps a name p to a utility column; results are lse_p, mean_p_k and var_p_k.
    For one utility the paths are read once: sums are kept per whole-number band of the
    utility, where no exponential can overflow, and the few bands of an OD are combined.
    For several, the maxima are found first.
    """
    moments = [(k, 1) for k in features]

    def weighted(e: Column, tag: str) -> list[Column]:
        return [F.sum(e).alias(f"_e_{tag}"),
                *[F.sum(e * F.pow(C(k), F.lit(float(n)))).alias(f"_m{n}_{tag}_{k}")
                  for k, n in moments]]

    if len(outs) == 1:
        (tag, v), = outs.items()
        bands = paths.groupBy(*OD, F.floor(v).cast("double").alias("_band")).agg(
            *weighted(F.exp(C(v) - F.floor(v)), tag))
        # an OD has few bands, however many paths it has
        bands = bands.withColumn(f"_top_{tag}", F.max("_band").over(Window.partitionBy(*OD)))
        names = [f"_e_{tag}", *[f"_m{n}_{tag}_{k}" for k, n in moments]]
        shift = F.exp(C("_band") - C(f"_top_{tag}"))
        dim = bands.groupBy(*OD).agg(
            F.first(f"_top_{tag}").alias(f"_top_{tag}"),
            *[F.sum(C(c) * shift).alias(c) for c in names])
    else:
        tops = paths.groupBy(*OD).agg(*[F.max(v).alias(f"_top_{t}") for t, v in outs.items()])
        shifted = od_join(paths, tops, stored)
        dim = shifted.groupBy(*OD).agg(
            *[F.first(f"_top_{t}").alias(f"_top_{t}") for t in outs],
            *[c for t, v in outs.items() for c in weighted(F.exp(C(v) - C(f"_top_{t}")), t)])
    cols = []
    for t in outs:
        cols.append((C(f"_top_{t}") + F.log(f"_e_{t}")).alias(f"lse_{t}"))
        for k in features:
            mean = C(f"_m1_{t}_{k}") / C(f"_e_{t}")
            cols.append(mean.alias(f"mean_{t}_{k}"))
    out = dim.select(*OD, *cols)
    if not second:
        return out
    # squares are taken around the means that are known now, so large means cost no digits
    away = od_join(paths, out, stored)
    spread = [F.sum(F.exp(C(v) - C(f"lse_{t}")) * F.pow(C(k) - C(f"mean_{t}_{k}"), 2)).alias(f"var_{t}_{k}")
              for t, v in outs.items() for k in features]
    return out.join(away.groupBy(*OD).agg(*spread), OD)


def probabilities(paths: DataFrame, outs: Mapping[str, str], od: DataFrame | None = None,
                  features: Sequence[str] = (), second: bool = False, stored: bool = False) -> DataFrame:
    """Logit probabilities inside each choice set: {new column: utility column}.

    ``od`` adds its demand ``q``; ``features`` add the OD moments of those columns. ``stored``
    says that ``paths`` are written already and cheap to read again.
    """
    dim = choice_moments(paths, outs, features, second, stored)
    if od is not None:
        dim = dim.join(od.select(*OD, "q"), OD, "left")
    df = od_join(paths, dim, stored)
    return df.withColumns({p: F.exp(C(v) - C(f"lse_{p}")) for p, v in outs.items()}).drop(
        *[f"lse_{p}" for p in outs])


def choice(paths: DataFrame, links: DataFrame, theta: Mapping[str, float],
           path_size: float = 0.0) -> DataFrame:
    """Feature sums, utility v and probability p of each path."""
    return probabilities(pin(path_utility(paths, links, theta, path_size)), {"p": "v"})


def path_flows(paths: DataFrame, od: DataFrame, v: str = "v", stored: bool = False) -> DataFrame:
    """Paths with probability p and flow f = q p; ODs without demand carry nothing."""
    df = probabilities(paths, {"p": v}, od, stored=stored)
    return df.withColumn("q", F.coalesce("q", F.lit(0.0))).withColumn("f", C("q") * C("p"))


def link_sums(paths: DataFrame, columns: Sequence[str], values: DataFrame | None = None
              ) -> DataFrame:
    """Sum of path columns over each link that some path uses.

    ``columns`` come from ``values`` by path_id, or from ``paths`` themselves.
    """
    df = paths.select("segs", *columns) if values is None else (
        paths.select("path_id", "segs").join(values.select("path_id", *columns), "path_id"))
    seg = df.select(F.explode("segs").alias("seg"), *columns).select("seg.*", *columns)
    return seg.groupBy(*LINK).agg(*[F.sum(c).alias(c) for c in columns])


def link_flows(paths: DataFrame, links: DataFrame, values: DataFrame | None = None,
               flow: str = "f", out: str = "x") -> DataFrame:
    """Links with their flow; 0 on links without a path."""
    sums = link_sums(paths, [flow], values).withColumnRenamed(flow, out)
    return links.drop(out).join(sums, LINK, "left").na.fill(0.0, [out])


def predict(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Mapping[str, float],
            path_size: float = 0.0) -> DataFrame:
    """Link flows at fixed link features. Utilities are written once: the log-sums and the
    probabilities both read them."""
    flows = path_flows(pin(path_utility(paths, links, theta, path_size)), od)
    return link_flows(paths, links, flows)


def equal_choice(paths: DataFrame, links: DataFrame, od: DataFrame) -> DataFrame:
    """Link flows when every path of an OD is as likely as the others."""
    sizes = paths.groupBy(*OD).agg(F.count(F.lit(1)).alias("_n")).join(od, OD)
    share = sizes.select(*OD, (C("q") / C("_n")).alias("f"))
    return link_flows(od_join(paths.select("path_id", *OD, "segs"), share), links)


# equilibrium ---------------------------------------------------------------------------

def fisk_objective(paths: DataFrame, links: DataFrame, flows: DataFrame,
                   theta: Mapping[str, float], flow: str = "f", time_fn=None) -> DataFrame:
    """One row: travel-time integral, exogenous utility, entropy and their total."""
    time_fn = performance(time_fn)
    loaded = link_flows(paths, links, flows, flow)
    z = {k: w for k, w in theta.items() if k != "tt"}
    on_links = loaded.agg(
        (F.lit(float(theta["tt"])) * F.sum(time_fn.integral("x"))).alias("time_part"),
        F.sum(linear_utility(z) * C("x")).alias("exogenous_part")).withColumn("_one", F.lit(1))
    on_paths = flows.agg(F.sum(entropy(flow)).alias("entropy")).withColumn("_one", F.lit(1))
    return on_links.join(on_paths, "_one").select(
        "time_part", "exogenous_part", "entropy",
        (C("time_part") + C("exogenous_part") - C("entropy")).alias("objective"))


def _blend(lam: float, a: str = "f1", b: str = "f2") -> Column:
    return C(a) + F.lit(float(lam)) * (C(b) - C(a))


def fisk_slopes(paths: DataFrame, links: DataFrame, flows: DataFrame,
                theta: Mapping[str, float], lambdas: Sequence[float], time_fn=None) -> DataFrame:
    """Derivative of the objective along f1 -> f2 at each step size, one row per step."""
    return _along(step_ends(paths, links, flows), flows, theta, lambdas, True, time_fn)


def fisk_scan(paths: DataFrame, links: DataFrame, flows: DataFrame,
              theta: Mapping[str, float], lambdas: Sequence[float], time_fn=None) -> DataFrame:
    """Objective along f1 -> f2 at each step size, one row per step, in one job.

    Link flows are linear in the step, so the paths are exploded once for all steps.
    """
    return _along(step_ends(paths, links, flows), flows, theta, lambdas, False, time_fn)


def step_ends(paths: DataFrame, links: DataFrame, flows: DataFrame) -> DataFrame:
    """Links with their flows f1 and f2 at the two ends of a step."""
    ends = link_sums(paths, ["f1", "f2"], flows)
    return links.drop("f1", "f2").join(ends, LINK, "left").na.fill(0.0, ["f1", "f2"])


def _along(loaded: DataFrame, flows: DataFrame, theta: Mapping[str, float],
           lambdas: Sequence[float], slope: bool, time_fn=None) -> DataFrame:
    time_fn = performance(time_fn)
    z = linear_utility({k: w for k, w in theta.items() if k != "tt"})
    tt = F.lit(float(theta["tt"]))
    link_aggs, path_aggs = [], []
    for i, lam in enumerate(lambdas):
        x = _blend(lam)
        if slope:
            link_aggs.append(F.sum((tt * time_fn(x) + z) * (C("f2") - C("f1"))).alias(f"a{i}"))
            d = almost_zero(C("f2") - C("f1"), 1e-12)
            path_aggs.append(F.sum(d * (F.log(x + 1e-12) + 1)).alias(f"b{i}"))
        else:
            link_aggs.append(F.sum(tt * time_fn.integral(x) + z * x).alias(f"a{i}"))
            path_aggs.append(F.sum(entropy(x)).alias(f"b{i}"))
    one = F.lit(1)
    both = loaded.agg(*link_aggs).withColumn("_one", one).join(
        flows.agg(*path_aggs).withColumn("_one", one), "_one")
    name = "slope" if slope else "objective"
    cells = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(lam)).alias("lambda"),
                               (C(f"a{i}") - C(f"b{i}")).alias(name))
                      for i, lam in enumerate(lambdas)])
    return both.select(F.explode(cells).alias("c")).select("c.*")


def line_search(paths: DataFrame, links: DataFrame, flows: DataFrame,
                theta: Mapping[str, float], points: int = 11, search: str = "grid", time_fn=None) -> float:
    """Step size toward f2 with the best objective.

    The grid search stops before the first step that does not improve; bisection halves
    the interval by the sign of the derivative.
    """
    if search == "grid":
        grid = [i / (points - 1) for i in range(points)]
        best = None
        scan = fisk_scan(paths, links, flows, theta, grid, time_fn).collect()
        for row in sorted(scan, key=lambda r: r["step"]):
            if best is not None and not row["objective"] > best["objective"]:
                break
            best = row
        return float(best["lambda"])
    loaded = pin(step_ends(paths, links, flows))
    left, right, mid = 0.0, 1.0, 0.5
    for _ in range(points):
        mid = 0.5 * (left + right)
        if _along(loaded, flows, theta, [mid], True, time_fn).first()["slope"] < 0:
            right = mid
        else:
            left = mid
    return mid


# (iteration, paths, links, flows with f1 and f2) -> step toward f2
StepRule = Callable[[int, DataFrame, DataFrame, DataFrame], float]


@dataclass
class Equilibrium:
    """Final path flows (path_id, o, d, p, q, f) and links (x, tt), one log row per iteration;
    the path set if it was grown."""

    flows: DataFrame
    links: DataFrame
    log: list[dict[str, float]]
    paths: PathSet | None = None


def equilibrium(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Mapping[str, float],
                iters: int = 9, method: str | StepRule = "fw", accuracy: float = 1e-4,
                points: int = 11, search: str = "grid", uncongested: bool = False,
                exogenous_times: str | None = None, path_size: float = 0.0,
                known: DataFrame | None = None, time_fn=None, generation: Generation | None = None,
                path_set: PathSet | None = None, round_: int = 0) -> Equilibrium:
    """Fixed point of travel times and path choice.

    With ``generation`` the path set grows first, by the cheapest paths at the initial times,
    is assigned once, cut back to the paths worth keeping, and the iterations begin anew on
    what is left. ``path_set`` is the set of an earlier call, to which round ``round_`` is
    added; ``paths`` is not read then. The first log row counts generated, added and removed
    paths.

    Starts from the assignment at free flow. Each iteration assigns at the current
    times and moves toward the result, by 1 / (n + 1) (``msa``) or a line search
    (``fw``), until the objective changes by less than ``accuracy``; ``method`` may also
    be a step rule. Uncongested and exogenous-time modes stop after one assignment.

    The paths are written once, bucketed by path, and only read after that; what moves
    between iterations are narrow path flows, written to the checkpoint folder so that
    lineage stays short and executors can be lost. ``known`` holds feature sums that do
    not change; with it, ``paths`` should already be stored.
    """
    time_fn = performance(time_fn)
    rules: dict[str, StepRule] = {
        "msa": lambda n, paths_, links_, both: 1.0 / (n + 1),
        "fw": lambda n, paths_, links_, both: line_search(paths_, links_, both, theta, points,
                                                          search, time_fn)}
    if not callable(method) and method not in rules:
        raise ValueError(f"unknown method: {method}")
    rule = method if callable(method) else rules[method]
    still = uncongested or exogenous_times is not None
    start = C(exogenous_times) if exogenous_times else time_fn(F.lit(0.0))
    links = links.withColumn("tt", start.cast("double"))

    if generation is not None:
        grown = path_set or PathSet.of(paths)
        counts = {"iter": -1, "n_removed": 0, **grown.grow(links, od, theta, generation, round_)}
        names = [k for k in theta if still or k != "tt"]
        sums = pin(grown.feature_sums(links, names)) if names else None
        if generation.keep:
            first = probabilities(pin(path_utility(grown.table(), links, theta, path_size, sums)), {"p": "v"})
            counts["n_removed"] = grown.select(first, generation)
            sums = pin(grown.feature_sums(links, names)) if names else None
        table = pin(grown.table().select("path_id", *OD, "segs"))
        if path_size:
            sizes = path_size_factors(table)
            sums = pin(sizes if sums is None else sums.join(sizes.select("path_id", "path_size"), "path_id"))
        done = _iterate(table, links, od, theta, iters, rule, accuracy, still, path_size, sums, time_fn)
        done.log.insert(0, counts)
        done.paths = grown
        return done

    def run(stored: DataFrame, sums: DataFrame | None) -> Equilibrium:
        return _iterate(stored, links, od, theta, iters, rule, accuracy, still, path_size, sums,
                        time_fn)

    if known is not None:
        return run(paths, known if still else known.drop("tt"))
    narrow = paths.select("path_id", *OD, "segs")
    if still:
        return run(narrow, fixed_sums(narrow, links, theta, still, path_size))
    with bucketed(narrow, "path_id") as stored:
        return run(stored, fixed_sums(stored, links, theta, still, path_size))


def _iterate(paths, links, od, theta, iters, rule, accuracy, still, path_size, known, time_fn
             ) -> Equilibrium:
    def assign(now: DataFrame, out: str) -> DataFrame:
        v = pin(path_utility(paths, now, theta, path_size, known).select("path_id", *OD, "v"))
        return path_flows(v, od).select("path_id", *OD, "p", "q", C("f").alias(out))

    state = pin(assign(links, "f1"))
    log: list[dict[str, float]] = []

    def record(n: int, step: float) -> float:
        value = float(fisk_objective(paths, links, state, theta, "f1", time_fn).first()["objective"])
        prev = log[-1]["objective"] if log else None
        gap = abs((value - prev) / value) if prev is not None and value else float("nan")
        log.append({"iter": n, "step": step, "objective": value, "gap": gap})
        return gap

    if not still:
        record(0, 1.0)
        for n in range(1, iters + 1):
            links = pin(link_flows(paths, links, state, "f1").withColumn("tt", time_fn(C("x"))))
            both = pin(assign(links, "f2").join(state.select("path_id", "f1"), "path_id"))
            step = rule(n, paths, links, both)
            state = pin(both.withColumn("f1", _blend(step)).drop("f2"))
            if record(n, step) < accuracy:
                break
    final = link_flows(paths, links, state, "f1")
    if not still:
        final = final.withColumn("tt", time_fn(C("x")))
    return Equilibrium(state.withColumnRenamed("f1", "f"), pin(final), log)


def fixed_sums(paths: DataFrame, links: DataFrame, theta: Mapping[str, float], still: bool,
               path_size: float = 0.0) -> DataFrame | None:
    """Sums of features that no iteration changes, written once; times only when still."""
    names = [k for k in theta if still or k != "tt"]
    if not names and not path_size:
        return None
    df = path_sums(paths, links, names) if names else None
    if path_size:
        sizes = path_size_factors(paths)
        df = sizes if df is None else df.join(sizes.select("path_id", "path_size"), "path_id")
    return pin(df)
