"""Attaching feeds, features and attributes to links, paths and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bpr_time
from ..scale import lookup, salted_join
from .filters import LINK

# Link attribute -> (probe statistic, power of the time unit factor). Fixed values.
PROBE_TO_LINK = {
    "speed_max": ("speed_max", 0), "speed_avg": ("speed_avg", 0), "speed_sd": ("speed_sd", 0),
    "speed_ref_avg": ("speed_ref_avg", 0), "speed_ref_sd": ("speed_ref_sd", 0),
    "speed_hist_avg": ("speed_hist_avg", 0), "speed_hist_sd": ("speed_hist_sd", 0),
    "tt_cv": ("traveltime_cv", 0), "speed_cv": ("speed_cv", 0),
    "tt_avg": ("traveltime_avg", 1), "tt_sd": ("traveltime_sd", 1),
    "tt_var": ("traveltime_var", 2), "road_closures": ("road_closure_any", 0),
}
TIME_UNIT = {"minutes": 1.0, "seconds": 60.0}


def merge_probe(links: DataFrame, speeds: DataFrame, units: str = "minutes") -> DataFrame:
    """Probe statistics of the matched segment; 0 where no segment matches."""
    factor = TIME_UNIT[units]
    dim = speeds.select("segment_id", *[
        (F.col(src).cast("double") * F.lit(factor ** power)).alias(name)
        for name, (src, power) in PROBE_TO_LINK.items()])
    return salted_join(links, dim, ["segment_id"], "left").na.fill(0.0, list(PROBE_TO_LINK))


def remap_nodes(edges: DataFrame, nodes: DataFrame, init: str = "init_id",
                term: str = "term_id", node_id: str = "id", key: str = "key") -> DataFrame:
    """Replace original node ids by sequential keys u and v; both ends must be known."""
    a = nodes.select(F.col(node_id).alias(init), F.col(key).alias("u"))
    b = nodes.select(F.col(node_id).alias(term), F.col(key).alias("v"))
    return lookup(lookup(edges, a, init, "inner"), b, term, "inner")


def _stations(links: DataFrame, on: Sequence[str], stations: DataFrame | None) -> DataFrame:
    """Links and their stations, from the array ``station_ids`` or a long table (on, station_id)."""
    if stations is None:
        return links.select(*on, "lane", F.explode("station_ids").alias("station_id"))
    return stations.select(*on, "station_id").join(links.select(*on, "lane"), list(on))


def link_counts(links: DataFrame, counts: DataFrame, flow: str = "flow_total",
                factor: float = 1.0, on: Sequence[str] = ("u", "v"), stations: DataFrame | None = None
                ) -> DataFrame:
    """Mean over the stations of a link; NULL when none reports."""
    each = salted_join(_stations(links, on, stations), counts.select("station_id", flow), ["station_id"],
                       "left")
    mean = each.groupBy(*on).agg((F.avg(flow) * F.lit(float(factor))).alias("count"))
    return links.select(*on).join(mean, list(on), "left")


def link_lane_counts(links: DataFrame, counts: DataFrame, on: Sequence[str] = ("u", "v"),
                     lanes: int = 8, stations: DataFrame | None = None) -> DataFrame:
    """Count of the link's own lane; without one, the mean over all lanes with a value.

    Adds ``matched`` and ``imputed`` flags.
    """
    cols = [f"flow_total_lane_{i}" for i in range(1, lanes + 1)]
    dim = counts.select("station_id", *cols).withColumn("_seen", F.lit(1))
    each = salted_join(_stations(links, on, stations), dim, ["station_id"], "left")
    own = F.element_at(F.array(*cols), F.col("lane").cast("int"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    filled = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    per = each.groupBy(*on).agg(
        F.avg(own).alias("_own"), F.try_divide(F.sum(total), F.sum(filled)).alias("_any"),
        F.max("_seen").alias("_seen"))
    out = links.select(*on).join(per, list(on), "left")
    seen = F.col("_seen").isNotNull()
    return out.select(
        *on, F.coalesce("_own", F.when(seen, F.col("_any"))).alias("count"),
        F.col("_own").isNotNull().cast("int").alias("matched"),
        (seen & F.col("_own").isNull()).cast("int").alias("imputed"))


def attach(links: DataFrame, values: DataFrame, on: Sequence[str] = ("u", "v"),
           strict: bool = False) -> DataFrame:
    """Left join of link columns by key; columns already present are replaced.

    ``strict`` fails when some link has no row in ``values``.
    """
    on = list(on)
    new = [c for c in values.columns if c not in on]
    out = links.drop(*new).join(values.withColumn("_found", F.lit(1)), on, "left")
    if strict:
        lost = out.where(F.col("_found").isNull()).limit(1).count()
        if lost:
            raise ValueError("some links have no row in the attached table")
    return out.drop("_found")


def set_bpr(links: DataFrame, bpr: DataFrame, on: Sequence[str] = ("u", "v")) -> DataFrame:
    """Performance parameters by link and the zero-flow travel time they give."""
    out = attach(links, bpr, on)
    return out.withColumn("tt", bpr_time(F.lit(0.0)))


def merge_features(*frames: DataFrame, on: Sequence[str] = ("u", "v")) -> DataFrame:
    """Inner join of feature frames by link key."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(on))
    return out


def with_true_values(estimates: DataFrame, truth: Mapping[str, float] | DataFrame) -> DataFrame:
    """True parameter values next to estimates, NULL when unknown."""
    if not isinstance(truth, DataFrame):
        truth = estimates.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in truth.items()], "parameter string, theta_true double")
    return lookup(estimates, truth, "parameter")


def match_stations_by_id(links: DataFrame, layer: DataFrame, ids: Sequence[str],
                         on: Sequence[str] = ("u", "v")) -> DataFrame:
    """``station_ids`` array from the id columns of a layer, keeping only digit texts."""
    listed = F.filter(F.array(*[F.trim(F.col(c)) for c in ids]),
                      lambda t: F.coalesce(t.rlike(r"^\d+$"), F.lit(False)))
    dim = layer.select(*on, F.transform(listed, lambda t: t.cast("int")).alias("station_ids"))
    out = attach(links, dim, on)
    return out.withColumn("station_ids", F.coalesce("station_ids",
                                                    F.array().cast("array<int>")))


def new_paths(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate paths their OD does not have yet."""
    return candidates.join(existing.select("o", "d", "path_id"), ["o", "d", "path_id"],
                           "left_anti")


def path_links(paths: DataFrame, links: DataFrame, strict: bool = True) -> DataFrame:
    """Links of every path as rows (path_id, o, d, seq, u, v, idx), checked to exist."""
    hops = paths.select("path_id", "o", "d", F.posexplode("segs").alias("seq", "seg")).select(
        "path_id", "o", "d", "seq", "seg.*")
    known = links.select(*LINK).withColumn("_found", F.lit(1))
    out = lookup(hops, known, LINK, "left" if strict else "inner")
    if strict and out.where(F.col("_found").isNull()).limit(1).count():
        raise ValueError("some path uses a link that does not exist")
    return out.drop("_found")


def overlap_with(paths: DataFrame, chosen: DataFrame) -> DataFrame:
    """Jaccard similarity of each path's nodes to one chosen path of its OD.

    ``chosen`` has one row (o, d, chosen_id, chosen_nodes) per OD, so the result has one
    row per path: similarities of all pairs inside an OD are never listed.
    """
    both = salted_join(paths, chosen, ["o", "d"])
    return both.withColumn("jaccard", jaccard(F.col("nodes"), F.col("chosen_nodes")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def copy_attributes(target: DataFrame, source: DataFrame, columns: Sequence[str],
                    on: Sequence[str] = ("u", "v")) -> DataFrame:
    """Take ``columns`` of matching links of another link table."""
    return attach(target, source.select(*on, *columns), on)


def assemble_links(edges: DataFrame, nodes: DataFrame, alpha: float = 0.15,
                   beta: float = 4.0, numeric: Sequence[str] = ("length", "ff_speed", "capacity")
                   ) -> DataFrame:
    """Link table from edges and node positions with typed attributes and default BPR."""
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    out = lookup(lookup(edges, a, "u", "inner"), b, "v", "inner")
    for name in numeric:
        out = out.withColumn(name, F.col(name).try_cast("double"))
    return (out.withColumn("alpha", F.lit(float(alpha))).withColumn("beta", F.lit(float(beta)))
            .withColumn("tf", F.try_divide(F.col("length"), F.col("ff_speed")))
            .withColumn("k", F.col("capacity")))
