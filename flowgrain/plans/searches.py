"""Searches over many candidates of weights and demand scales at once.

Candidates are columns: their travel times, utilities, flows and steps move through the same
jobs, so that a grid costs little more than one run. Each candidate has its own step and stop.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entropy, linear_utility, performance
from ..operators.filters import LINK
from ..operators.network import OD
from ..session import bucketed, pin
from .choice import feature_sums, link_sums, path_sums, probabilities
from .stats import pseudo_inverse, t_two_sided

C = F.col
Theta = Mapping[str, float]
#: Candidates whose columns share one job.
BLOCK = 20


def candidates(weights: Sequence[Theta], scales: Sequence[float] = (1.0,)) -> list[tuple[Theta, float]]:
    """Every weight vector with every demand scale."""
    return [(t, float(s)) for t in weights for s in scales]


def random_candidates(bounds: Mapping[str, tuple[float, float]], scale_bounds: tuple[float, float], draws: int,
                      seed: int = 0) -> list[tuple[Theta, float]]:
    """Repeatable uniform draws of weights and of a demand scale inside bounds."""
    rng = np.random.default_rng(seed)
    return [({k: float(rng.uniform(a, b)) for k, (a, b) in bounds.items()}, float(rng.uniform(*scale_bounds)))
            for _ in range(draws)]


def equilibria(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[tuple[Theta, float]],
               iters: int = 9, accuracy: float = 1e-4, time_fn=None, block: int = BLOCK) -> DataFrame:
    """Rows (candidate, theta as JSON, scale, iterations, n, sse) of congested equilibria.

    Every candidate moves by 1 / (n + 1) and stops by itself once its objective changes by less
    than ``accuracy``; a block ends with its last candidate. Only a few numbers for each
    candidate come to the driver in an iteration.
    """
    out = None
    with bucketed(paths.select("path_id", *OD, "segs"), "path_id") as stored:
        names = sorted({k for t, _ in grid for k in t} - {"tt"})
        base = pin(path_sums(stored, links, names)) if names else pin(stored.select("path_id", *OD))
        for start in range(0, len(grid), block):
            rows = _equilibria(stored, links, od, base, list(grid)[start:start + block], start, iters, accuracy,
                               performance(time_fn))
            out = rows if out is None else out.unionByName(rows)
        return pin(out)


def _equilibria(paths, links, od, base, grid, start, iters, accuracy, time_fn) -> DataFrame:
    m = range(len(grid))

    def assign(now: DataFrame, out: str) -> DataFrame:
        times = path_sums(paths, now, [f"tt_{i}" for i in m]).drop(*OD)
        df = times.join(base, "path_id")
        for i, (theta, _) in enumerate(grid):
            own = linear_utility({k: w for k, w in theta.items() if k != "tt"})
            df = df.withColumn(f"v_{i}", own + F.lit(float(theta.get("tt", 0.0))) * C(f"tt_{i}"))
        df = pin(df.select("path_id", *OD, *[f"v_{i}" for i in m]))
        df = probabilities(df, {f"p_{i}": f"v_{i}" for i in m}, od, stored=True)
        q = F.coalesce("q", F.lit(0.0))
        return df.select("path_id", *[(q * F.lit(s) * C(f"p_{i}")).alias(f"{out}_{i}") for i, (_, s) in enumerate(grid)])

    def loaded(state: DataFrame) -> DataFrame:
        sums = link_sums(paths, [f"f_{i}" for i in m], state).withColumnsRenamed({f"f_{i}": f"x_{i}" for i in m})
        return links.drop("x", "tt").join(sums, LINK, "left").na.fill(0.0, [f"x_{i}" for i in m])

    def objectives(at: DataFrame, state: DataFrame) -> list[float]:
        on_links = at.agg(*[F.sum(
            F.lit(float(t.get("tt", 0.0))) * time_fn.integral(f"x_{i}")
            + linear_utility({k: w for k, w in t.items() if k != "tt"}) * C(f"x_{i}")).alias(f"a{i}")
            for i, (t, _) in enumerate(grid)]).first()
        on_paths = state.agg(*[F.sum(entropy(f"f_{i}")).alias(f"b{i}") for i in m]).first()
        return [float(on_links[f"a{i}"]) - float(on_paths[f"b{i}"]) for i in m]

    free = links.drop("x").withColumns({f"tt_{i}": time_fn(F.lit(0.0)).cast("double") for i in m})
    state = pin(assign(free, "f"))
    active, done, last = set(m), [0] * len(grid), [None] * len(grid)
    for n in range(1, iters + 1):
        at = pin(loaded(state))
        now = objectives(at, state)
        for i in list(active):
            if last[i] is not None and now[i] and abs((now[i] - last[i]) / now[i]) < accuracy:
                active.discard(i)
        if not active:
            break
        last = now
        times = at.withColumns({f"tt_{i}": time_fn(C(f"x_{i}")) for i in m})
        both = assign(times, "g").join(state, "path_id")
        step = [1.0 / (n + 1) if i in active else 0.0 for i in m]
        state = pin(both.select("path_id", *[
            (C(f"f_{i}") + F.lit(step[i]) * (C(f"g_{i}") - C(f"f_{i}"))).alias(f"f_{i}") for i in m]))
        for i in active:
            done[i] = n
    seen = loaded(state).where(C("count").isNotNull())
    one = seen.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.pow(C(f"x_{i}") - C("count"), 2)).alias(f"s{i}") for i in m])
    cells = F.array(*[F.struct(
        F.lit(start + i).alias("candidate"), F.to_json(F.create_map(*[
            x for k in sorted(t) for x in (F.lit(k), F.lit(float(t[k])))])).alias("theta"),
        F.lit(s).alias("scale"), F.lit(done[i]).alias("iterations"), C(f"s{i}").alias("sse"))
        for i, (t, s) in enumerate(grid)])
    return pin(one.select("n", F.explode(cells).alias("c")).select("c.*", "n"))


def normal_matrices(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[tuple[Theta, float]],
                    known: DataFrame | None = None, block: int = 8) -> DataFrame:
    """(candidate, n, sse, jj, theta): residuals and J'J (row by row) of all weights at each
    candidate, at the travel times of ``links``."""
    names = list(grid[0][0])
    base = pin(feature_sums(paths, links, names, known))
    out = None
    for start in range(0, len(grid), block):
        part = list(grid)[start:start + block]
        df = base
        for i, (theta, _) in enumerate(part):
            df = df.withColumn(f"_v{i}", linear_utility(theta))
        df = probabilities(df, {f"_p{i}": f"_v{i}" for i in range(len(part))}, od, names)
        cols = {}
        for i, (_, scale) in enumerate(part):
            f = F.coalesce("q", F.lit(0.0)) * F.lit(scale) * C(f"_p{i}")
            cols[f"x_{i}"] = f
            cols.update({f"j_{i}_{a}": f * (C(k) - C(f"mean__p{i}_{k}")) for a, k in enumerate(names)})
        sums = link_sums(paths, list(cols), df.select("path_id", *[c.alias(n) for n, c in cols.items()]))
        at = links.drop("x").join(sums, LINK, "left").na.fill(0.0, list(cols)).where(C("count").isNotNull())
        aggs = [F.count(F.lit(1)).alias("n")]
        cells = []
        for i, (theta, scale) in enumerate(part):
            aggs.append(F.sum(F.pow(C(f"x_{i}") - C("count"), 2)).alias(f"s{i}"))
            squares = [F.sum(C(f"j_{i}_{a}") * C(f"j_{i}_{b}")) for a in range(len(names)) for b in range(len(names))]
            aggs.append(F.array(*squares).alias(f"jj{i}"))
            cells.append(F.struct(F.lit(start + i).alias("candidate"), F.lit(scale).alias("scale"), C(f"s{i}").alias("sse"),
                                  C(f"jj{i}").alias("jj"), F.array(*[F.lit(float(theta[k])) for k in names]).alias("theta")))
        rows = at.agg(*aggs).select("n", F.explode(F.array(*cells)).alias("c")).select("c.*", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def t_grid(paths: DataFrame, links: DataFrame, od: DataFrame, grid: Sequence[tuple[Theta, float]], h0: float = 0.0,
           known: DataFrame | None = None) -> DataFrame:
    """(candidate, scale, parameter, theta, t_test, p_value): t values of all weights at each
    candidate; each task solves the small systems of its candidates."""
    names = list(grid[0][0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                p, dof = len(names), r.n - len(names)
                spread = np.sqrt(np.maximum(np.diag(pseudo_inverse(np.array(r.jj).reshape(p, p))) * r.sse / dof, 0.0))
                for k, est, s in zip(names, r.theta, spread, strict=True):
                    t = 0.0 if s == 0 or np.isclose(est - h0, 0.0) else (est - h0) / s
                    rows.append((r.candidate, r.scale, k, est, float(t), float(t_two_sided(t, dof))))
            yield pd.DataFrame(rows, columns=["candidate", "scale", "parameter", "theta", "t_test", "p_value"])

    return normal_matrices(paths, links, od, grid, known).mapInPandas(
        run, "candidate int, scale double, parameter string, theta double, t_test double, p_value double")


def best(found: DataFrame) -> DataFrame:
    """The candidate of the least loss, the first of equals."""
    top: Column = F.min(F.struct("sse", "candidate", "theta", "scale")).alias("b")
    return found.agg(top).select("b.candidate", "b.theta", "b.scale", "b.sse")
