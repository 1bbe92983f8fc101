"""Path sets that grow by column generation and shrink by selection.

A set is a list of generations, each written once. New paths are appended as a generation
with the feature sums of just those paths; paths that a selection leaves out are marked by id
and not rewritten, so a set of many rounds costs what its new paths cost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_utility
from ..operators.aggregates import sample_by_demand
from ..operators.joins import new_paths
from ..operators.network import OD, diverse_paths, k_shortest, top_paths
from ..operators.sampling import uniform
from ..session import pin, store

C = F.col
SAMPLINGS = ("demand", "sequential", "random")


@dataclass(frozen=True)
class Generation:
    """How a set grows: ``n_paths`` cheapest paths for a ``share`` of the ODs, picked by falling
    demand, in blocks of falling demand one after the other, or at random; then, with ``keep``,
    at most that many paths stay in an OD, by probability and, weighted by ``dissimilarity``,
    by how little they overlap."""

    n_paths: int
    share: float = 1.0
    sampling: str = "demand"
    keep: int | None = None
    dissimilarity: float = 0.0

    def __post_init__(self):
        if self.sampling not in SAMPLINGS:
            raise ValueError(f"unknown sampling: {self.sampling}")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


@dataclass
class PathSet:
    """Generations of paths (path_id, o, d, nodes, segs) and the ids marked as left out."""

    generations: list[DataFrame]
    removed: DataFrame | None = None
    log: list[dict[str, int]] = field(default_factory=list)
    sums: dict[tuple[str, ...], list[DataFrame]] = field(default_factory=dict)

    @classmethod
    def of(cls, paths: DataFrame) -> PathSet:
        return cls([paths.select("path_id", *OD, "nodes", "segs")])

    def _kept(self, df: DataFrame) -> DataFrame:
        return df if self.removed is None else df.join(self.removed, "path_id", "left_anti")

    def table(self) -> DataFrame:
        return self._kept(_union(self.generations))

    def feature_sums(self, links: DataFrame, names: Sequence[str]) -> DataFrame:
        """Sums of link features that do not change, made once for each generation."""
        from .choice import path_sums
        held = self.sums.setdefault(tuple(names), [])
        for generation in self.generations[len(held):]:
            held.append(pin(path_sums(generation, links, list(names))))
        return self._kept(_union(held))

    def grow(self, links: DataFrame, od: DataFrame, theta: Mapping[str, float], rule: Generation, round_: int = 0
             ) -> dict[str, int]:
        """Add the cheapest paths that are not there yet; links cost what they take from utility."""
        cost = links.withColumn("weight", F.greatest(F.lit(0.0), -linear_utility(theta)))
        if rule.sampling == "random":
            picked = od.where((C("q") != 0) & (uniform(OD, round_) <= rule.share))
        else:
            picked = sample_by_demand(od, rule.share, round_ if rule.sampling == "sequential" else 0)
        made = k_shortest(cost, picked, rule.n_paths).drop("cost")
        fresh = pin(new_paths(made, self.table()))
        if self.removed is not None:
            # a path that was left out and is cheap again comes back; it has been written already
            self.removed = pin(self.removed.join(fresh.select("path_id"), "path_id", "left_anti"))
            known = _union(self.generations).select("path_id")
            new = store(fresh.join(known, "path_id", "left_anti").select("path_id", *OD, "nodes", "segs"))
        else:
            new = store(fresh.select("path_id", *OD, "nodes", "segs"))
        self.generations.append(new)
        counts = {"n_generated": made.count(), "n_added": fresh.count()}
        self.log.append(counts)
        return counts

    def select(self, chosen: DataFrame, rule: Generation) -> int:
        """Leave out all but the ``keep`` best paths of each OD; ``chosen`` holds probabilities
        p by path_id. Returns how many go."""
        rows = self.table().join(chosen.select("path_id", F.round("p", 12).alias("p")), "path_id")
        sizes = rows.groupBy(*OD).agg(F.count(F.lit(1)).alias("_n")).where(C("_n") > rule.keep)
        full = pin(rows.join(sizes.select(*OD), OD, "left_semi").drop("segs"))
        best = (diverse_paths(full, rule.keep, rule.dissimilarity) if rule.dissimilarity
                else top_paths(full.drop("nodes"), rule.keep))
        lost = pin(full.select("path_id").join(best.select("path_id"), "path_id", "left_anti"))
        n = lost.count()
        self.removed = lost if self.removed is None else pin(self.removed.unionByName(lost))
        if self.log:
            self.log[-1]["n_removed"] = n
        return n
