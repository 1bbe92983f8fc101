"""Estimation in stages with an iteration table that a run goes on from.

Every iteration leaves a row of its numbers (weights, loss, damping, the next weights) and the
predicted links in a folder of the shared storage; the row is written last, so an iteration
either counts as a whole or is done again. A run that is begun again reads the rows and goes on
after the last one. Reports and the choice of informative links read the same table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import performance
from ..operators.filters import LINK, informative_links
from ..operators.network import OD
from ..session import pin, shared_dir
from .choice import equilibrium, feature_sums, fixed_sums
from .estimation import (_project, adjust_demand, damped_step, errors, loss, scale_stage,
                         step_candidates)
from .generation import Generation, PathSet

C = F.col
STEP = "stage_no int, stage string, iter int, theta string, objective double, damping double, next string, next_damping double"


@dataclass(frozen=True)
class Stage:
    """One stage: its steps and, before them, steps of one multiplier for all weights; with
    ``demand`` (pull to the prior, step size) demand moves after each iteration too."""

    name: str
    iters: int = 10
    method: str = "ngd"
    eta: float = 0.1
    fixed: tuple[str, ...] = ()
    scale_steps: int = 0
    scale_eta: float = 0.1
    demand: tuple[float, float] | None = None


@dataclass
class Learned:
    """Best iteration of all stages, and where the iteration table is."""

    theta: dict[str, float]
    objective: float
    stage: str
    od: DataFrame
    links: DataFrame
    folder: str
    paths: PathSet | None = None
    log: list[dict[str, object]] = field(default_factory=list)


def _at(folder: str, kind: str, stage: int, n: int) -> str:
    return f"{folder}/{kind}/{stage:03d}-{n:05d}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def iterations(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finished iteration; weights as JSON."""
    if not _exists(spark, f"{folder}/steps"):
        return spark.createDataFrame([], STEP)
    return spark.read.schema(STEP).parquet(f"{folder}/steps/*")


def link_log(spark: SparkSession, folder: str, stages: Sequence[int] | None = None) -> DataFrame:
    """(stage_no, iter, u, v, idx, count, x, err) of all finished iterations."""
    done = iterations(spark, folder).select("stage_no", "iter")
    rows = spark.read.parquet(f"{folder}/links/*").join(done, ["stage_no", "iter"])
    return rows if stages is None else rows.where(C("stage_no").isin(list(stages)))


def only_informative(links: DataFrame, log: DataFrame) -> DataFrame:
    """Links whose counts stay only where the prediction error moved in the iterations of ``log``."""
    seen = log.where(C("count").isNotNull()).withColumn("iter", C("stage_no") * F.lit(1_000_000) + C("iter"))
    good = informative_links(seen, LINK).select(*LINK, F.lit(True).alias("_good"))
    return links.join(good, LINK, "left").withColumn("count", F.when(C("_good"), C("count"))).drop("_good")


def learn(paths: DataFrame, links: DataFrame, od: DataFrame, theta: Mapping[str, float], stages: Sequence[Stage],
          folder: str | None = None, signs: Mapping[str, str] | None = None, inner: Mapping[str, object] | None = None,
          generation: Generation | None = None, informative: bool = False) -> Learned:
    """Run the stages one after the other, each from the best weights of the one before.

    ``folder`` names an iteration table to go on from (or to begin); without it a new one is
    made in the shared folder. ``inner`` are options of the equilibrium. With ``generation`` the
    path set grows in every iteration. With ``informative`` counts that no iteration of the
    earlier stages could move are left out from the second stage on.
    """
    spark = links.sparkSession
    folder = folder or f"{shared_dir(spark)}/learning-{uuid.uuid4().hex}"
    inner = dict(inner or {"uncongested": True})
    still = bool(inner.get("uncongested") or inner.get("exogenous_times"))
    size = float(inner.get("path_size", 0.0))
    if still:
        times = inner.get("exogenous_times")
        links = links.withColumn("tt", C(times) if times else performance(inner.get("time_fn"))(F.lit(0.0)))
    links, prior = pin(links), od
    done = {(r["stage_no"], r["iter"]): r for r in iterations(spark, folder).collect()}  # one row an iteration
    theta = {k: float(t) for k, t in theta.items()}
    grown = PathSet.of(paths) if generation else None
    table = pin(paths.select("path_id", *OD, "segs")) if grown is None else None
    base = fixed_sums(table, links, theta, still, size) if grown is None else None
    log: list[dict[str, object]] = []
    total = 0

    def steps_of(stage_no: int) -> list:
        return [r for (s, _), r in sorted(done.items()) if s == stage_no]

    for s, stage in enumerate(stages):
        if s:
            best = min(steps_of(s - 1), key=lambda r: (r["objective"], r["iter"]))
            theta = json.loads(best["theta"])
            if informative:
                links = pin(only_informative(links, link_log(spark, folder, range(s))))
        lam = 1e-2
        for n in range(1, stage.iters + 1):
            total += 1
            if (s, n) in done:
                row = done[s, n]
                log.append(_entry(row))
                theta, lam = json.loads(row["next"]), row["next_damping"]
                if stage.demand:
                    od = spark.read.parquet(_at(folder, "od", s, n))
                if grown is not None:
                    grown.generations.append(spark.read.parquet(_at(folder, "paths", s, n)))
                    grown.removed = spark.read.parquet(_at(folder, "removed", s, n))
                continue
            if n == 1 and stage.scale_steps:
                at = grown.table() if grown is not None else table
                m, _ = scale_stage(at, links, od, theta, stage.scale_steps, stage.scale_eta)
                theta = {k: m * t for k, t in theta.items()}
            if grown is not None:
                state = equilibrium(paths, links, od, theta, generation=generation, path_set=grown, round_=total - 1, **inner)
                grown.generations[-1].write.mode("overwrite").parquet(_at(folder, "paths", s, n))
                removed = grown.removed if grown.removed is not None else grown.generations[0].select("path_id").limit(0)
                removed.write.mode("overwrite").parquet(_at(folder, "removed", s, n))
                table, base = pin(grown.table().select("path_id", *OD, "segs")), None
            else:
                state = equilibrium(table, links, od, theta, known=base, **inner) if base is not None else equilibrium(
                    table, links, od, theta, **inner)
            sse = float(loss(state.links).first()["sse"])
            snapshot = errors(state.links).select(F.lit(s).alias("stage_no"), F.lit(n).alias("iter"), *LINK, "count", "x", "err")
            snapshot.write.mode("overwrite").parquet(_at(folder, "links", s, n))
            following, next_lam = theta, lam
            if n < stage.iters:
                now = state.links.drop("x")
                sums = base if still and base is not None else pin(feature_sums(table, now, list(theta), base))
                if stage.method == "lm":
                    following, next_lam, _ = damped_step(table, now, od, theta, lam, fixed=stage.fixed, known=sums,
                                                         path_size=size)
                else:
                    following = step_candidates(table, now, od, theta, stage.method, stage.eta, fixed=stage.fixed,
                                                known=sums, path_size=size)[1][0]
                following = _project(following, signs or {})
            if stage.demand:
                od = adjust_demand(table, state.flows, state.links, od, prior, *stage.demand)
                od.write.mode("overwrite").parquet(_at(folder, "od", s, n))
                od = spark.read.parquet(_at(folder, "od", s, n))
            row = (s, stage.name, n, json.dumps(theta), sse, lam, json.dumps(following), next_lam)
            spark.createDataFrame([row], STEP).coalesce(1).write.mode("overwrite").parquet(_at(folder, "steps", s, n))
            done[s, n] = spark.createDataFrame([row], STEP).first()
            log.append(_entry(done[s, n]))
            theta, lam = following, next_lam
    rows = [r for _, r in sorted(done.items())]
    best = min(rows, key=lambda r: (r["objective"], r["stage_no"], r["iter"]))
    at = spark.read.parquet(_at(folder, "links", best["stage_no"], best["iter"]))
    return Learned(json.loads(best["theta"]), best["objective"], best["stage"], od, at, folder, grown, log)


def _entry(row) -> dict[str, object]:
    return {"stage": row["stage"], "iter": row["iter"], "objective": row["objective"],
            **{f"theta_{k}": t for k, t in json.loads(row["theta"]).items()}}
