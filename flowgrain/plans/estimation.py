"""Least-squares estimation of preference weights from counts, and inference.

With probabilities that sum to 1 in a choice set, the derivative of a path's
probability in weight k is p (z_k - mean z_k), the mean taken with p. So one OD
aggregation gives all first derivatives, a second one the second derivatives, and one
explode-and-add carries them to links. Only p-by-p sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import interval_label, linear_utility, performance, soft_threshold
from ..operators.aggregates import lowest_share
from ..operators.filters import LINK
from ..operators.network import OD, path_size_factors
from ..scale import salted_join, scalar_join
from ..session import bucketed, pin
from .choice import (equal_choice, equilibrium, feature_sums, fixed_sums, link_sums, path_sums,
                     path_utility, predict, probabilities)
from .stats import f_critical, f_upper, pseudo_inverse, t_critical, t_two_sided

C = F.col
Theta = Mapping[str, float]


# loss ----------------------------------------------------------------------------------

def errors(links: DataFrame) -> DataFrame:
    """Prediction minus count by link and its square; links without a count get 0."""
    e = F.coalesce(C("x") - C("count"), F.lit(0.0))
    return links.withColumn("err", e).withColumn("sq_err", e * e)


def loss(links: DataFrame) -> DataFrame:
    """Number of counts and sum of squared errors."""
    return errors(links).agg(F.count("count").alias("n"), F.sum("sq_err").alias("sse"))


def loss_congested(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
                   **options) -> DataFrame:
    """Loss of the equilibrium prediction."""
    return loss(equilibrium(paths, links, od, theta, **options).links)


def loss_equal_choice(paths: DataFrame, links: DataFrame, od: DataFrame) -> DataFrame:
    return loss(equal_choice(paths, links, od))


# derivatives ---------------------------------------------------------------------------

def response(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
             second: bool = False, known: DataFrame | None = None,
             path_size: float = 0.0) -> DataFrame:
    """Links with flow ``x``, derivatives ``j_k`` and, if asked, second ones ``h_k``.

    ``known`` may hold feature sums of the paths, written earlier.
    """
    names = list(theta)
    # written once: the moments and the probabilities both read it
    df = pin(path_utility(paths, links, theta, path_size, known))
    df = probabilities(df, {"p": "v"}, od, names, second)
    df = df.withColumn("f", F.coalesce("q", F.lit(0.0)) * C("p"))
    cols = ["f"]
    for k in names:
        away = C(k) - C(f"mean_p_{k}")
        df = df.withColumn(f"j_{k}", C("f") * away)
        cols.append(f"j_{k}")
        if second:
            df = df.withColumn(f"h_{k}", C("f") * (away * away - C(f"var_p_{k}")))
            cols.append(f"h_{k}")
    sums = link_sums(paths, cols, df).withColumnRenamed("f", "x")
    out = links.drop("x").join(sums, LINK, "left")
    return out.na.fill(0.0, ["x", *cols[1:]])


def jacobian(resp: DataFrame, features: Sequence[str]) -> DataFrame:
    """Derivatives of link flows as rows (link, feature, value)."""
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), C(f"j_{k}").alias("jacobian"))
                      for k in features])
    return resp.select(*LINK, F.explode(cells).alias("c")).select(*LINK, "c.*")


def _err() -> Column:
    return F.when(C("count").isNotNull(), C("x") - C("count"))


def gradient(resp: DataFrame, features: Sequence[str]) -> DataFrame:
    """Derivative of the loss per feature, one row."""
    return resp.agg(*[(2.0 * F.sum(C(f"j_{k}") * _err())).alias(f"g_{k}") for k in features])


def diagonal_hessian(resp: DataFrame, features: Sequence[str]) -> DataFrame:
    """Second derivative of the loss per feature, one row."""
    seen = C("count").isNotNull()
    return resp.agg(*[
        (2.0 * F.sum(F.when(seen, C(f"j_{k}") * C(f"j_{k}") + C(f"h_{k}") * _err())))
        .alias(f"h_{k}") for k in features])


def normal_sums(resp: DataFrame, features: Sequence[str], second: bool = False) -> DataFrame:
    """n, loss, J'J and J'r over observed links in one aggregation, one row."""
    seen = C("count").isNotNull()
    aggs = [F.count("count").alias("n"), F.sum(_err() * _err()).alias("sse")]
    for i, a in enumerate(features):
        aggs.append(F.sum(C(f"j_{a}") * _err()).alias(f"jr_{a}"))
        for b in features[i:]:
            aggs.append(F.sum(F.when(seen, C(f"j_{a}") * C(f"j_{b}"))).alias(f"jj_{a}_{b}"))
        if second:
            aggs.append(F.sum(C(f"h_{a}") * _err()).alias(f"hr_{a}"))
    return resp.agg(*aggs)


def _matrix(row, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    p = len(features)
    jj, jr = np.zeros((p, p)), np.zeros(p)
    for i, a in enumerate(features):
        jr[i] = row[f"jr_{a}"]
        for j in range(i, p):
            jj[i, j] = jj[j, i] = row[f"jj_{a}_{features[j]}"]
    return jj, jr


# steps ---------------------------------------------------------------------------------

def project_signs(params: DataFrame, theta: str = "est") -> DataFrame:
    """Parameters on the wrong side of 0 for their expected sign become 0."""
    x = C(theta)
    return params.withColumn(theta, F.when(C("sign") == "+", F.greatest(x, F.lit(0.0)))
                             .when(C("sign") == "-", F.least(x, F.lit(0.0))).otherwise(x))


def _project(theta: dict[str, float], signs: Mapping[str, str]) -> dict[str, float]:
    return {k: max(0.0, t) if signs.get(k) == "+" else min(0.0, t) if signs.get(k) == "-" else t
            for k, t in theta.items()}


# Update rules of the p-vector: (J'J, J'r, diagonal curvature, step, damping) -> move.
UPDATES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, float, float], np.ndarray]] = {
    "gd": lambda jj, jr, hr, eta, lam: -eta * 2.0 * jr,
    "ngd": lambda jj, jr, hr, eta, lam: -eta * jr / (np.linalg.norm(jr) or 1.0),
    "newton": lambda jj, jr, hr, eta, lam: -jr / np.where(np.diag(jj) + hr == 0, np.inf,
                                                          np.diag(jj) + hr),
    "gauss-newton": lambda jj, jr, hr, eta, lam: -pseudo_inverse(jj) @ jr,
    "lm": lambda jj, jr, hr, eta, lam: -pseudo_inverse(jj + lam * np.diag(np.diag(jj))) @ jr,
}


def step_candidates(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
                    method: str = "gauss-newton", eta: float = 0.1,
                    damping: Sequence[float] = (0.0,), fixed: Sequence[str] = (),
                    known: DataFrame | None = None, path_size: float = 0.0) -> tuple[float, list[dict[str, float]]]:
    """Current loss and the next parameters for each damping value.

    One aggregation leaves Spark: the loss, J'J and J'r of the free features. ``method``
    may be any callable with the signature of the update rules.
    """
    free = [k for k in theta if k not in fixed]
    second = method == "newton"
    resp = response(paths, links, od, theta, second, known, path_size)
    row = normal_sums(resp, free, second).first()
    jj, jr = _matrix(row, free)
    hr = np.array([row[f"hr_{k}"] if second else 0.0 for k in free])
    rule = UPDATES[method] if isinstance(method, str) else method
    out = []
    for lam in damping:
        move = rule(jj, jr, hr, eta, lam)
        out.append({k: float(theta[k]) + (float(move[free.index(k)]) if k in free else 0.0)
                    for k in theta})
    return float(row["sse"]), out


def losses_at(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[Theta],
              block: int = 16, known: DataFrame | None = None, path_size: float = 0.0
              ) -> DataFrame:
    """Loss at each candidate of ``grid`` as rows (candidate, n, sse).

    Candidates are columns: probabilities of all of them share two OD aggregations and
    one explode of the paths. ``block`` candidates go in one job.
    """
    flows = flows_at(paths, links, od, grid, block, known, path_size)
    seen = C("count").isNotNull()
    out = None
    for start, df in flows:
        size = min(block, len(grid) - start)
        one = df.agg(F.count("count").alias("n"), *[
            F.sum(F.when(seen, F.pow(C(f"flow_{i}") - C("count"), 2))).alias(f"s{i}")
            for i in range(size)])
        cells = F.array(*[F.struct(F.lit(start + i).alias("candidate"), C(f"s{i}").alias("sse"))
                          for i in range(size)])
        rows = one.select("n", F.explode(cells).alias("c")).select("c.candidate", "n", "c.sse")
        out = rows if out is None else out.unionByName(rows)
    return out


def flows_at(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[Theta],
             block: int = 16, known: DataFrame | None = None, path_size: float = 0.0
             ) -> list[tuple[int, DataFrame]]:
    """Links with flows flow_0, flow_1, … for each block of candidates."""
    names = sorted({k for t in grid for k in t})
    base = feature_sums(paths, links, names, known)
    own = F.lit(0.0)
    if path_size:
        sizes = path_size_factors(paths).select("path_id", "path_size")
        base = base.join(sizes, "path_id")
        own = F.lit(float(path_size)) * F.log("path_size")
    out = []
    for start in range(0, len(grid), block):
        part = list(grid)[start:start + block]
        df = base
        for i, theta in enumerate(part):
            df = df.withColumn(f"_v{i}", linear_utility(theta) + own)
        df = probabilities(df, {f"_p{i}": f"_v{i}" for i in range(len(part))}, od)
        df = df.select("path_id", *[(F.coalesce("q", F.lit(0.0)) * C(f"_p{i}")).alias(f"flow_{i}")
                                 for i in range(len(part))])
        sums = link_sums(paths, [f"flow_{i}" for i in range(len(part))], df)
        loaded = links.join(sums, LINK, "left").na.fill(0.0, [f"flow_{i}" for i in range(len(part))])
        out.append((start, loaded))
    return out


def flows_long(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[Theta],
               block: int = 16) -> DataFrame:
    """Link flows at each candidate as rows (u, v, idx, candidate, x)."""
    out = None
    for start, df in flows_at(paths, links, od, grid, block):
        size = min(block, len(grid) - start)
        cells = F.array(*[F.struct(F.lit(start + i).alias("candidate"), C(f"flow_{i}").alias("x"))
                          for i in range(size)])
        rows = df.select(*LINK, F.explode(cells).alias("c")).select(*LINK, "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def damped_step(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
                damping: float = 1e-2, down: float = 2.0, up: float = 3.0,
                fixed: Sequence[str] = (), known: DataFrame | None = None,
                path_size: float = 0.0) -> tuple[dict[str, float], float, float]:
    """Levenberg-Marquardt step: damping, damping / down and damping * up are tried in one
    job; the best is taken if it lowers the loss, otherwise the weights stay and the
    damping grows. Returns (weights, next damping, loss)."""
    tries = [damping, damping / down, damping * up]
    now, steps = step_candidates(paths, links, od, theta, "lm", damping=tries, fixed=fixed,
                                 known=known, path_size=path_size)
    found = losses_at(paths, links, od, steps, known=known, path_size=path_size).collect()
    rows = {r["candidate"]: r["sse"] for r in found}
    best = min(rows, key=lambda i: (rows[i], i))
    if rows[best] < now:
        return steps[best], tries[best], rows[best]
    return dict(theta), tries[2], now


# estimation ----------------------------------------------------------------------------

@dataclass
class Fit:
    """Best iteration of an estimation and the log of all."""

    theta: dict[str, float]
    objective: float
    links: DataFrame
    flows: DataFrame
    log: list[dict[str, object]] = field(default_factory=list)


def estimate(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta, iters: int = 10,
             method: str = "ngd", eta: float = 0.1, signs: Mapping[str, str] | None = None,
             fixed: Sequence[str] = (), inner: Mapping[str, object] | None = None,
             stage: str = "norefined") -> Fit:
    """Alternate parameter steps and equilibrium; keep the iteration with the lowest loss.

    ``inner`` are options of the equilibrium (e.g. ``uncongested=True``).
    """
    inner = dict(inner or {"uncongested": True})
    still = bool(inner.get("uncongested") or inner.get("exogenous_times"))
    theta = {k: float(t) for k, t in theta.items()}
    # sums that no iteration changes are written once
    if still:
        times = inner.get("exogenous_times")
        links = links.withColumn("tt", C(times) if times else performance(inner.get("time_fn"))(F.lit(0.0)))
    with bucketed(paths.select("path_id", *OD, "segs"), "path_id") as stored:
        base = fixed_sums(stored, links, theta, still, float(inner.get("path_size", 0.0)))
        return _alternate(stored, links, od, theta, iters, method, eta, signs or {}, fixed, inner,
                          still, base, stage)


def _alternate(paths, links, od, theta, iters, method, eta, signs, fixed, inner, still, base, stage
               ) -> Fit:
    log: list[dict[str, object]] = []
    best: Fit | None = None
    lam = 1e-2
    for n in range(1, iters + 1):
        state = equilibrium(paths, links, od, theta, known=base, **inner)
        sse = float(loss(state.links).first()["sse"])
        log.append({"stage": stage, "iter": n, "objective": sse,
                    **{f"theta_{k}": t for k, t in theta.items()}})
        if best is None or sse < best.objective:
            best = Fit(dict(theta), sse, state.links, state.flows)
        if n == iters:
            break
        at = state.links.drop("x")
        size = float(inner.get("path_size", 0.0))
        sums = base if still else pin(feature_sums(paths, at, list(theta), base))
        if method == "lm":
            theta, lam, _ = damped_step(paths, at, od, theta, lam, fixed=fixed, known=sums,
                                        path_size=size)
        else:
            theta = step_candidates(paths, at, od, theta, method, eta, fixed=fixed, known=sums,
                                    path_size=size)[1][0]
        theta = _project(theta, signs)
    best.log = log
    return best


def scale_stage(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
                iters: int = 3, eta: float = 0.1) -> tuple[float, list[float]]:
    """One multiplier for all weights, moved against the sign of the gradient."""
    base = path_sums(paths, links, list(theta)).withColumn("scaled", linear_utility(theta))
    base = pin(base)
    m, trail = 1.0, []
    for _ in range(iters):
        resp = response(paths, links, od, {"scaled": m}, known=base)
        g = float(gradient(resp, ["scaled"]).first()["g_scaled"])
        m -= eta * float(np.sign(g))
        trail.append(m)
    return m, trail


def adjust_demand(paths: DataFrame, flows: DataFrame, links: DataFrame, od: DataFrame,
                  prior: DataFrame, weight: float = 1e2, step: float = 1e-4) -> DataFrame:
    """Projected gradient step on demand with a pull toward the prior.

    ``flows`` hold path probabilities p; ``links`` flows x and counts.
    """
    gap = F.coalesce(C("x") - C("count"), F.lit(0.0))
    hops = paths.select("path_id", *OD, "segs").join(flows.select("path_id", "p"), "path_id")
    hops = hops.select(*OD, "path_id", "p", F.explode("segs").alias("seg")).select(
        *OD, "path_id", "p", "seg.*")
    each = salted_join(hops, links.select(*LINK, gap.alias("_gap")), LINK)
    slope = each.groupBy(*OD).agg(F.sum(C("p") * C("_gap")).alias("_g"))
    out = od.join(slope, OD, "left").join(prior.select(*OD, C("q").alias("_q0")), OD, "left")
    out = scalar_join(out, {"_n": F.count(F.lit(1))}, links)
    move = (F.lit(2.0 * weight) * (C("q") - C("_q0")) + 2.0 * F.coalesce("_g", F.lit(0.0))) / C("_n")
    return out.select(*OD, F.greatest(F.lit(0.0), C("q") - F.lit(float(step)) * move).alias("q"))


# inference -----------------------------------------------------------------------------

def t_tests(resp: DataFrame, theta: Theta, h0: float = 0.0, alpha: float = 0.05,
            percent: float = 100.0) -> DataFrame:
    """Estimate, interval, t value and p value per parameter.

    ``percent`` below 100 keeps the observations with the lowest squared error for the
    error variance.
    """
    names = list(theta)
    row = normal_sums(resp, names).first()
    jj, _ = _matrix(row, names)
    n, sse = int(row["n"]), float(row["sse"])
    if percent < 100:
        low = lowest_share(errors(resp.where(C("count").isNotNull())), "sq_err", percent, LINK)
        got = low.agg(F.count(F.lit(1)).alias("n"), F.sum("sq_err").alias("sse")).first()
        n, sse = int(got["n"]), float(got["sse"])
    dof = n - len(names)
    if dof <= 0:
        raise ValueError("more parameters than observations")
    spread = np.sqrt(np.maximum(np.diag(pseudo_inverse(jj)) * sse / dof, 0.0))
    crit = t_critical(alpha, dof)
    rows = []
    for k, s in zip(names, spread):
        est = float(theta[k])
        t = 0.0 if np.isclose(est - h0, 0.0) or s == 0 else (est - h0) / s
        rows.append((k, est, float(crit * s), float(t), float(t_two_sided(t, dof))))
    spark = resp.sparkSession
    out = spark.createDataFrame(
        rows, "parameter string, est double, width_CI double, t_test double, p_value double")
    return out.select("parameter", "est", interval_label("est", "width_CI").alias("CI"),
                      "width_CI", "t_test", "p_value")


def f_test(full: DataFrame, restricted: DataFrame, p_full: int, p_restricted: int = 0
           ) -> DataFrame:
    """F value of nested models from their predicted link tables, one row."""
    a = loss(full).select(C("n"), C("sse").alias("sse_m2")).withColumn("_one", F.lit(1))
    b = loss(restricted).select(C("sse").alias("sse_m1")).withColumn("_one", F.lit(1))
    both = a.join(b, "_one").drop("_one")
    return both.select(
        F.lit(p_restricted).alias("dof_m1"), F.lit(p_full).alias("dof_m2"), "sse_m1", "sse_m2",
        "n", F.try_divide((C("sse_m1") - C("sse_m2")) / F.lit(float(p_full - p_restricted)),
                          C("sse_m2") / (C("n") - F.lit(p_full))).alias("F"))


def f_test_tails(row, alpha: float = 0.05) -> dict[str, float]:
    """Critical value and p value of a row of ``f_test``."""
    d1, d2 = row["dof_m2"] - row["dof_m1"], row["n"] - row["dof_m2"]
    return {"critical-F": f_critical(alpha, d1, d2), "p": f_upper(row["F"], d1, d2)}


def infer(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta, iters: int = 5,
          method: str = "lm", alpha: float = 0.05, **options) -> tuple[Fit, DataFrame, dict]:
    """Estimate, then test each parameter and the model against no preferences."""
    fit = estimate(paths, links, od, theta, iters, method, **options)
    at = fit.links.drop("x")
    size = float((options.get("inner") or {}).get("path_size", 0.0))
    resp = pin(response(paths, at, od, fit.theta, path_size=size))
    tests = t_tests(resp, fit.theta, alpha=alpha)
    none = predict(paths, at, od, {k: 0.0 for k in theta}, size)
    row = f_test(resp, none, len(theta)).first()
    return fit, tests, {**row.asDict(), **f_test_tails(row, alpha)}


# searches ------------------------------------------------------------------------------

def grid_scan(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta, name: str,
              values: Sequence[float]) -> DataFrame:
    """Loss, gradient and second derivative in one weight at each grid value.

    Rows (candidate, theta, sse, gradient, hessian); all values share one job.
    """
    names = list(theta)
    df = path_sums(paths, links, names)
    grid = [{**theta, name: float(x)} for x in values]
    for i, t in enumerate(grid):
        df = df.withColumn(f"_v{i}", linear_utility(t))
    df = pin(df)
    n = range(len(grid))
    df = probabilities(df, {f"_p{i}": f"_v{i}" for i in n}, od, [name], second=True)
    cols = []
    for i in n:
        f, away = F.coalesce("q", F.lit(0.0)) * C(f"_p{i}"), C(name) - C(f"mean__p{i}_{name}")
        cols += [f.alias(f"flow_{i}"), (f * away).alias(f"first_{i}"),
                 (f * (away * away - C(f"var__p{i}_{name}"))).alias(f"second_{i}")]
    names_out = [f"{a}_{i}" for i in n for a in ("flow", "first", "second")]
    sums = link_sums(paths, names_out, df.select("path_id", *cols))
    at = links.join(sums, LINK, "left").na.fill(0.0, names_out).where(C("count").isNotNull())
    aggs = []
    for i in n:
        e = C(f"flow_{i}") - C("count")
        aggs += [F.sum(e * e).alias(f"l{i}"), (2.0 * F.sum(C(f"first_{i}") * e)).alias(f"g{i}"),
                 (2.0 * F.sum(C(f"first_{i}") * C(f"first_{i}") + C(f"second_{i}") * e)).alias(f"d{i}"),
                 F.sum(C(f"first_{i}") * C(f"first_{i}")).alias(f"jj{i}"), F.count("count").alias(f"n{i}")]
    cells = F.array(*[F.struct(
        F.lit(i).alias("candidate"), F.lit(float(values[i])).alias("theta"),
        C(f"l{i}").alias("sse"), C(f"g{i}").alias("gradient"), C(f"d{i}").alias("hessian"),
        C(f"jj{i}").alias("jj"), C(f"n{i}").alias("n")) for i in n])
    return at.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


def grid_t_values(scan: DataFrame, h0: float = 0.0) -> DataFrame:
    """t value of the scanned weight at each grid value (one-parameter model)."""
    spread = F.sqrt(F.try_divide(C("sse"), C("n") - 1) * F.try_divide(F.lit(1.0), C("jj")))
    return scan.select("candidate", "theta",
                       F.coalesce(F.try_divide(C("theta") - F.lit(float(h0)), spread),
                                  F.lit(0.0)).alias("t_test"))


def best_candidate(scan: DataFrame) -> DataFrame:
    top = scan.agg(F.min(F.struct("sse", "candidate", "theta")).alias("_b"))
    return top.select(C("_b.theta").alias("theta"), C("_b.sse").alias("sse"))


def random_grid(bounds: Mapping[str, tuple[float, float]], draws: int, seed: int = 0
                ) -> list[dict[str, float]]:
    """Repeatable uniform draws of weights inside bounds."""
    rng = np.random.default_rng(seed)
    return [{k: float(rng.uniform(a, b)) for k, (a, b) in bounds.items()} for _ in range(draws)]


def demand_scale_losses(links: DataFrame, factors: Sequence[float]) -> DataFrame:
    """Loss when all demand is multiplied: flows at fixed times are linear in demand, so
    three sums give every factor."""
    seen = links.where(C("count").isNotNull())
    s = seen.agg(F.sum(C("x") * C("x")).alias("xx"), F.sum(C("x") * C("count")).alias("xc"),
                 F.sum(C("count") * C("count")).alias("cc"))
    cells = F.array(*[F.lit(float(f)) for f in factors])
    f = C("factor")
    return s.select("*", F.explode(cells).alias("factor")).select(
        "factor", (f * f * C("xx") - 2 * f * C("xc") + C("cc")).alias("sse"))


def lasso_path(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Theta,
               lambdas: Sequence[float]) -> DataFrame:
    """Loss with every weight pulled toward 0 by each lambda (candidate = its position)."""
    spark = links.sparkSession
    rows = [(i, k, float(t), float(lam)) for i, lam in enumerate(lambdas)
            for k, t in theta.items()]
    shrunk = spark.createDataFrame(rows, "i int, k string, t double, lam double").select(
        "i", "k", soft_threshold("t", C("lam")).alias("t")).collect()
    grid: list[dict[str, float]] = [{} for _ in lambdas]
    for r in shrunk:
        grid[r["i"]][r["k"]] = r["t"]
    return losses_at(paths, links, od, grid)


# parameters ----------------------------------------------------------------------------

def add_features(params: DataFrame, names: Sequence[str], sign: str | None = None,
                 true: float | None = None) -> DataFrame:
    """Rows for features the table does not have yet; ``true=0`` makes them sparse ones."""
    if not names:
        return params
    new = params.sparkSession.createDataFrame(
        [(n, sign, 0, None, true) for n in names],
        "parameter string, sign string, fixed int, init double, true double")
    fresh = new.join(params.select("parameter"), "parameter", "left_anti")
    return params.unionByName(fresh, allowMissingColumns=True)


def initial_values(params: DataFrame, kind: str = "zero", constant: float = 0.0,
                   spread: tuple[float, float] = (-1.0, 1.0), seed: int = 0) -> DataFrame:
    """Initial values: zero where missing, one constant, or uniform around the true value."""
    from ..operators.sampling import uniform
    if kind == "zero":
        value = F.coalesce("init", F.lit(0.0))
    elif kind == "constant":
        value = F.lit(float(constant))
    else:
        lo, hi = spread
        value = C("true") + uniform(["parameter"], seed) * F.lit(float(hi - lo)) + F.lit(float(lo))
    return params.withColumn("init", F.when(C("fixed") == 1, C("init")).otherwise(value))
