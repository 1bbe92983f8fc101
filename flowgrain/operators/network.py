"""Links, paths and choice sets as tables.

``links``: u, v, idx and attributes. ``paths``: path_id, o, d, nodes (array), segs
(array of struct(u, v, idx)). ``od``: o, d, q. A path is one row, so the incidence of
links and paths is an array column and no join is needed to spread path values to links.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import BROADCAST_ROWS, fits, lookup, ranked, salted_join, scalar_join
from ..session import pin
from .aggregates import sample_by_demand
from .filters import LINK
from .joins import jaccard, new_paths
from .routes import Routes

C = F.col
OD = ["o", "d"]


# links ---------------------------------------------------------------------------------

def adjacency(links: DataFrame) -> DataFrame:
    """Number of parallel links per ordered node pair, nonzero cells only."""
    return links.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def link_keys(adj: DataFrame) -> DataFrame:
    """Links of an adjacency table, parallel ones numbered 0..n-1. Numbers are dealt in blocks
    of bounded length, so that no row has to hold all of them."""
    size = 1024
    n = C("n").cast("long")
    blocks = (adj.where(n > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size))))
              .repartition("u", "v", "_block"))
    first = C("_block") * size
    return (blocks.withColumn("idx", F.explode(F.sequence(first, F.least(first + size, n) - 1)))
            .select("u", "v", C("idx").cast("string").alias("idx")))


def build_network(links: DataFrame, parallel: bool | None = None) -> tuple[DataFrame, bool]:
    """Links without loops, and whether any node pair has parallel links.

    ``parallel=False`` keeps the first of parallel links.
    """
    out = links.where(C("u") != C("v"))
    if parallel is None:
        parallel = adjacency(out).where(C("n") > 1).limit(1).count() > 0
    if not parallel:
        first = out.groupBy("u", "v").agg(F.min("idx").alias("idx"))
        out = out.join(first, LINK, "left_semi")
    return out, parallel


def links_from(links: DataFrame, sources: Sequence[int]) -> DataFrame:
    return links.where(C("u").isin(list(sources)))


# paths ---------------------------------------------------------------------------------

def consecutive(nodes: Column, idx: str = "0") -> Column:
    """Array of links between neighbouring nodes."""
    n = F.size(nodes)
    return F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        F.element_at(nodes, i).alias("u"), F.element_at(nodes, i + 1).alias("v"),
        F.lit(idx).alias("idx")))


def paths_from_nodes(df: DataFrame) -> DataFrame:
    """Path table from a ``nodes`` array column of at least two nodes."""
    out = df.where(F.size("nodes") >= 2)
    return out.select(
        F.array_join(F.transform("nodes", lambda n: n.cast("string")), "/").alias("path_id"),
        F.element_at("nodes", 1).alias("o"), F.element_at("nodes", -1).alias("d"), "nodes",
        consecutive(C("nodes")).alias("segs"))


def hop_rows(paths: DataFrame, *extra: str) -> DataFrame:
    """One row per path and link, with its position."""
    return paths.select("path_id", *OD, *extra, F.posexplode("segs").alias("seq", "seg")).select(
        "path_id", *OD, *extra, "seq", "seg.*")


def hops_by_lead(nodes: DataFrame) -> DataFrame:
    """Links of node sequences given as rows (path_id, seq, node)."""
    w = Window.partitionBy("path_id").orderBy("seq")
    return nodes.select("path_id", "seq", C("node").alias("u"),
                        F.lead("node").over(w).alias("v")).where(C("v").isNotNull())


def od_incidence(paths: DataFrame) -> DataFrame:
    return paths.select(*OD, "path_id").distinct()


def choice_set_sizes(paths: DataFrame) -> DataFrame:
    """Choice sets as one row per OD; the path-by-path matrix is never listed."""
    return paths.groupBy(*OD).agg(F.count(F.lit(1)).alias("n_paths"))


def choice_set_members(paths: DataFrame) -> DataFrame:
    """Position of each path within its OD and the size of its choice set."""
    return ranked(paths.select(*OD, "path_id"), OD, [C("path_id")], "pos", total="n_paths")


def load_paths(paths: DataFrame) -> dict[str, DataFrame]:
    """Incidence views that follow from the path table alone."""
    return {"paths": paths, "link_path": hop_rows(paths), "od_path": od_incidence(paths),
            "choice_sets": choice_set_sizes(paths)}


def _grown(links: DataFrame, starts: DataFrame, hops: int, allowed, ahead: bool) -> list[DataFrame]:
    """Simple partial paths (root, at, nodes, segs, cost) of 0 to ``hops`` links from ``starts``
    (root): onward along links, or backward with ``ahead`` false. ``allowed`` filters a round."""
    near, far = ("u", "v") if ahead else ("v", "u")
    step = pin(links.select(C(near).cast("int").alias("at"), C(far).cast("int").alias("_to"), C("idx").alias("_idx"), "_w"))
    small = fits(step)
    front = starts.select("root", C("root").cast("int").alias("at"), F.array(C("root").cast("int")).alias("nodes"),
                          F.array().cast("array<struct<u:int,v:int,idx:string>>").alias("segs"), F.lit(0.0).alias("cost"))
    rounds = [pin(front)]
    for hop in range(1, hops + 1):
        more = rounds[-1].join(F.broadcast(step), "at") if small else salted_join(rounds[-1], step, ["at"])
        more = more.where(~F.array_contains("nodes", C("_to")))
        ends = ("at", "_to") if ahead else ("_to", "at")
        seg = F.array(F.struct(C(ends[0]).alias("u"), C(ends[1]).alias("v"), C("_idx").alias("idx")))
        to = F.array("_to")
        more = more.select(
            "root", C("_to").alias("at"), (F.concat("nodes", to) if ahead else F.concat(to, "nodes")).alias("nodes"),
            (F.concat("segs", seg) if ahead else F.concat(seg, "segs")).alias("segs"), (C("cost") + C("_w")).alias("cost"))
        rounds.append(pin(allowed(more, hop)))
    return rounds


def enumerate_paths(links: DataFrame, cutoff: int, ods: DataFrame, weight: str | None = None) -> DataFrame:
    """All paths without repeated nodes of at most ``cutoff`` links of the listed ODs.

    Two frontiers meet: from the origins over the first half of the links of a path, from the
    destinations over the second half, so neither grows past half of ``cutoff``. A partial path
    stays only while the other end of one of its ODs can be reached with the links that are left.
    """
    cost = C(weight).cast("double") if weight else F.lit(1.0)
    plain = pin(links.where(C("u") != C("v")).select("u", "v", "idx", cost.alias("_w"), F.lit(1.0).alias("_hop")))
    pairs = pin(ods.select(*OD).where(C("o") != C("d")).distinct())

    def reach(own: str, other: str, graph: DataFrame) -> DataFrame:
        """(root, at, _left): links that a node is away from the nearest other end of a root."""
        away = distances_to(graph, pairs.select(C(other).alias("d")), "_hop", cutoff).withColumnRenamed("d", other)
        return pin(away.join(pairs, other).groupBy(C(own).alias("root"), C("node").alias("at")).agg(
            F.min("dist").alias("_left")))
    turned = plain.select(C("v").alias("u"), C("u").alias("v"), "_hop")
    to_d, to_o = reach("o", "d", plain), reach("d", "o", turned)

    def kept(table: DataFrame):
        return lambda more, hop: salted_join(more, table, ["root", "at"], "inner").where(
            C("_left") <= cutoff - hop).drop("_left")
    first = _grown(plain, pairs.select(C("o").alias("root")).distinct(), (cutoff + 1) // 2, kept(to_d), True)
    second = _grown(plain, pairs.select(C("d").alias("root")).distinct(), cutoff // 2, kept(to_o), False)
    out = None
    for length in range(1, cutoff + 1):
        head = first[(length + 1) // 2].select(C("root").alias("o"), "at", "nodes", "segs", "cost").join(pairs, "o")
        tail = second[length // 2].select(C("root").alias("d"), "at", C("nodes").alias("_nodes"), C("segs").alias("_segs"),
                                          C("cost").alias("_cost"))
        met = salted_join(head, tail, ["d", "at"], "inner").where(F.size(F.array_intersect("nodes", "_nodes")) == 1)
        met = met.select(*OD, F.concat("nodes", F.slice("_nodes", 2, F.size("_nodes"))).alias("nodes"),
                         F.concat("segs", "_segs").alias("segs"), (C("cost") + C("_cost")).alias("cost"))
        out = met if out is None else out.unionByName(met)
    ids = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "/")
    # a parallel link is part of the path's identity
    tail = F.array_join(F.transform("segs", lambda s: s.idx), "/")
    plain_id = F.forall("segs", lambda s: s.idx == "0")
    return out.select(F.when(plain_id, ids).otherwise(F.concat_ws("|", ids, tail)).alias("path_id"),
                      *OD, "nodes", "segs", "cost")


def _rounds(cutoff: int | None):
    """Round numbers up to ``cutoff``, or without end."""
    return count() if cutoff is None else range(cutoff)


def distances_to(links: DataFrame, targets: DataFrame, weight: str, cutoff: int | None = None
                 ) -> DataFrame:
    """Cheapest cost (node, d, dist) from every node to each target that it can reach, over
    at most ``cutoff`` links if that is given. Rounds end once nothing gets cheaper.

    A round writes only what got cheaper and looks up only the nodes next to that; the rounds
    are put together at the end, and in between when there are many.
    """
    step = links.select(C("u").alias("_u"), C("v").alias("node"),
                        C(weight).cast("double").alias("_w"))
    step = pin(step.groupBy("_u", "node").agg(F.min("_w").alias("_w")))
    small = fits(step)
    fresh = pin(targets.select(C("d").alias("node"), "d", F.lit(0.0).alias("dist")).distinct())
    known = fresh
    for n in _rounds(cutoff):
        grown = fresh.join(F.broadcast(step), "node") if small else salted_join(
            fresh, step, ["node"])
        grown = grown.groupBy(C("_u").alias("node"), "d").agg(F.min(C("dist") + C("_w")).alias("dist"))
        old = known.withColumnRenamed("dist", "_old")
        fresh = pin(grown.join(old.groupBy("node", "d").agg(F.min("_old").alias("_old")), ["node", "d"], "left")
                    .where(C("_old").isNull() | (C("dist") < C("_old"))).select("node", "d", "dist"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        if n % 8 == 7:
            known = pin(known.groupBy("node", "d").agg(F.min("dist").alias("dist")))
    return pin(known.groupBy("node", "d").agg(F.min("dist").alias("dist")))


def _held_routes(links: DataFrame, weight: str, rows: int):
    """The links as adjacency lists sent to every executor once; None if they do not fit."""
    step = links.where(C("u") != C("v")).select(
        C("u").cast("int").alias("u"), C("v").cast("int").alias("v"), C("idx").cast("string").alias("idx"),
        C(weight).cast("double").alias("w"))
    if not rows or not fits(step, rows):
        return None
    held = [tuple(r) for r in step.collect()]  # at most ``rows``
    if any(w is None or w < 0 for *_, w in held):
        raise ValueError("weights must not be negative or missing")
    return links.sparkSession.sparkContext.broadcast(held)


def _spread(ods: DataFrame) -> DataFrame:
    """ODs over tasks, equal destinations side by side in each."""
    context = ods.sparkSession.sparkContext
    return ods.repartition(max(2 * context.defaultParallelism, 8), *OD).sortWithinPartitions("d", "o")


def _k_in_tasks(held, ods: DataFrame, k: int) -> DataFrame:
    def run(batches):
        routes = Routes(held.value)
        for batch in batches:
            rows = []
            for o, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(p, o, d, nodes, idx, cost) for p, cost, nodes, idx in routes.cheapest(o, d, k)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)],
                ["path_id", *OD, "nodes", "idx", "cost"])

    pairs = _spread(ods.select(C("o").cast("int").alias("o"), C("d").cast("int").alias("d"))
                    .where("o <> d").distinct())
    found = pairs.mapInArrow(run, "path_id string, o int, d int, nodes array<int>, idx array<string>, cost double")
    segs = F.transform("idx", lambda x, i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"),
                                                    x.alias("idx")))
    return pin(found.select("path_id", *OD, "nodes", segs.alias("segs"), "cost"))


def k_shortest(links: DataFrame, ods: DataFrame, k: int, weight: str = "weight",
               cutoff: int | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The k cheapest simple paths of each OD, of at most ``cutoff`` links if that is given.

    Ties go to the smaller path id. Weights must not be negative. Links that fit into a
    broadcast of ``rows`` rows go to every task, which then searches its own ODs: a path that
    has been found splits what is left into classes with one cheapest path each, so the work
    grows with k times the length of a path. Larger tables, and searches with a cutoff, grow a
    frontier by joins: a partial path is dropped when its cost plus the cheapest way on exceeds
    the k-th best path, which the cheapest paths with one detour bound from the first hop on.
    """
    held = _held_routes(links, weight, rows) if cutoff is None else None
    if held is not None:
        return _k_in_tasks(held, ods, k)
    step = pin(links.where(C("u") != C("v")).select(
        C("u").cast("int").alias("_at"), C("v").cast("int").alias("_to"), C("idx").alias("_idx"),
        C(weight).cast("double").alias("_w")))
    small = fits(step)
    ods = pin(ods.select(*OD).where(C("o") != C("d")).distinct())
    ahead = distances_to(links, ods.select("d"), weight, cutoff).withColumnsRenamed(
        {"node": "_at", "dist": "_ahead"})
    ahead_small = fits(ahead)
    front = ods.select(*OD, C("o").cast("int").alias("_at"), F.lit("").alias("path_id"),
                       F.array(C("o").cast("int")).alias("nodes"),
                       F.array().cast("array<struct<u:int,v:int,idx:string>>").alias("segs"),
                       F.lit(0.0).alias("cost"))
    rank = Window.partitionBy(*OD).orderBy("cost", "path_id")
    found = None
    least = detour_bounds(step, ods, ahead, k) if cutoff is None else None
    if least is not None:
        front = salted_join(front, least, OD)
    for _ in _rounds(cutoff):
        grown = (front.join(F.broadcast(step), "_at") if small
                 else salted_join(front, step, ["_at"]))
        grown = grown.where(~F.array_contains("nodes", C("_to"))).select(
            *OD, C("_to").alias("_at"), F.concat("nodes", F.array("_to")).alias("nodes"),
            F.concat("segs", F.array(F.struct(C("_at").alias("u"), C("_to").alias("v"),
                                              C("_idx").alias("idx")))).alias("segs"),
            (C("cost") + C("_w")).alias("cost"), *(["_least"] if least is not None else []))
        grown = (grown.join(F.broadcast(ahead), ["_at", "d"]) if ahead_small
                 else salted_join(grown, ahead, ["_at", "d"]))
        if least is not None:
            grown = grown.where(C("_least").isNull() | (C("cost") + C("_ahead") <= C("_least") + 1e-9))
        if k == 1:
            # of the ways to one node, the cheapest, of equals the least as text, is enough
            text = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "/")
            one = F.row_number().over(Window.partitionBy(*OD, "_at").orderBy(F.round("cost", 9), text))
            grown = grown.withColumn("_one", one).where("_one = 1").drop("_one")
        elif found is not None:
            # k rows per OD at most, so the bound is one row per OD
            bound = found.withColumn("_r", F.row_number().over(rank)).where(C("_r") == k).select(
                *OD, C("cost").alias("_bound"))
            grown = salted_join(grown, bound, OD, "left").where(
                C("_bound").isNull() | (C("cost") + C("_ahead") <= C("_bound") + 1e-9)).drop("_bound")
        grown = pin(grown.drop("_ahead"))
        ids = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "/")
        tail = F.array_join(F.transform("segs", lambda s: s.idx), "/")
        plain = F.forall("segs", lambda s: s.idx == "0")
        ended = grown.where(C("_at") == C("d")).select(
            F.when(plain, ids).otherwise(F.concat_ws("|", ids, tail)).alias("path_id"),
            *OD, "nodes", "segs", "cost")
        pool = ended if found is None else found.unionByName(ended)
        found = pin(pool.withColumn("_r", F.row_number().over(rank)).where(C("_r") <= k).drop("_r"))
        front = grown.where(C("_at") != C("d")).withColumn("path_id", F.lit(""))
        if front.limit(1).count() == 0:
            break
    return found


def detour_bounds(step: DataFrame, ods: DataFrame, ahead: DataFrame, k: int) -> DataFrame:
    """(o, d, _least): a cost that at least k simple paths of the OD do not exceed; null where
    fewer such paths are known.

    The paths meant follow the cheapest tree of the destination but for one link. Each node of
    a cheapest path is reached in rounds (one row for each OD); a link that leaves it leads to a
    path of its own, whose way on is simple if it is cheaper than from the node itself.
    """
    # the tree: of the links that begin a cheapest way, the least one
    way = step.join(ahead.withColumnsRenamed({"_at": "_to", "_ahead": "_on"}), "_to").join(ahead, ["_at", "d"])
    links = way.select("_at", "_to", "_idx", "_w", "d", "_on", "_ahead", (C("_w") + C("_on")).alias("_via"))
    links = pin(links)
    tree = links.where(C("_via") <= C("_ahead") + 1e-9).where(C("_on") < C("_ahead")).groupBy("_at", "d").agg(
        F.min(F.struct("_to", "_idx", "_w")).alias("_t")).select("_at", "d", "_t.*")
    at = ods.select(*OD, C("o").cast("int").alias("_at"), F.lit(0.0).alias("_cost"))
    costs = None
    while True:
        # a way on that only gets cheaper never comes back to the nodes before it; links that
        # begin a cheapest way are left out, so that no path is counted twice
        other = links.where((C("_on") < C("_ahead")) & (C("_via") > C("_ahead") + 1e-9))
        leave = at.join(other, ["_at", "d"]).select(*OD, (C("_cost") + C("_via")).alias("_c"))
        at = pin(at.join(tree, ["_at", "d"]).select(*OD, C("_to").alias("_at"), (C("_cost") + C("_w")).alias("_cost"))
                 .where(C("_at") != C("d")))
        costs = leave if costs is None else costs.unionByName(leave)
        best = F.row_number().over(Window.partitionBy(*OD).orderBy("_c"))
        costs = pin(costs.withColumn("_r", best).where(C("_r") < max(k, 2)).drop("_r"))
        if k == 1 or at.isEmpty():
            break
    own = ahead.select(C("_at").alias("o"), "d", C("_ahead").alias("_least"))
    nth = costs.withColumn("_r", F.row_number().over(Window.partitionBy(*OD).orderBy("_c"))).where(C("_r") == k - 1)
    bound = own if k == 1 else nth.withColumnRenamed("_c", "_least")
    return pin(ods.join(bound.select(*OD, "_least"), OD, "left"))


def k_shortest_retry(links: DataFrame, ods: DataFrame, k: int, weight: str = "weight",
                     cutoff: int = 10, factor: int = 2, attempts: int = 10) -> DataFrame:
    """``k_shortest`` again with a longer cutoff for the ODs still short of k paths."""
    found, todo = None, ods.select(*OD).where(C("o") != C("d")).distinct()
    for attempt in range(attempts):
        got = k_shortest(links, todo, k, weight, cutoff)
        have = got.groupBy(*OD).agg(F.count(F.lit(1)).alias("_n")).where(C("_n") >= k)
        full = got.join(have.select(*OD), OD, "left_semi")
        rest = pin(todo.join(have.select(*OD), OD, "left_anti"))
        last = attempt + 1 == attempts or rest.limit(1).count() == 0
        keep = got if last else full
        found = keep if found is None else found.unionByName(keep)
        if last:
            break
        todo, cutoff = rest, cutoff * factor
    return found


def _load_in_tasks(held, od: DataFrame) -> DataFrame:
    """Link flows (u, v, idx, x) of the demand ``od``; a row without a link counts lost ODs."""
    def run(batches):
        routes = Routes(held.value)
        flow, lost, target, wanted = [0.0] * len(routes.links), 0, None, {}

        def close() -> int:
            return 0 if target is None else routes.load(target, wanted, flow)
        for batch in batches:
            for o, d, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != target:
                    lost += close()
                    target, wanted = d, {}
                wanted[o] = wanted.get(o, 0.0) + q
        lost += close()
        rows = [(routes.nodes[u], routes.nodes[v], i, x) for (u, v, i, _), x in zip(routes.links, flow, strict=True) if x]
        rows += [(None, None, None, float(lost))] if lost else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4,
                                            [pa.int32(), pa.int32(), pa.string(), pa.float64()], strict=True)],
            [*LINK, "x"])

    pairs = _spread(od.select(C("o").cast("int").alias("o"), C("d").cast("int").alias("d"), C("q").cast("double").alias("q")))
    return pairs.mapInArrow(run, "u int, v int, idx string, x double")


def _load_by_rounds(links: DataFrame, od: DataFrame, weight: str) -> DataFrame:
    """As ``_load_in_tasks`` by joins: one next link for each node and destination, and demand
    that moves one link a round, added up where it meets."""
    ahead = distances_to(links, od.select("d"), weight)
    lost = od.join(ahead.select(C("node").alias("o"), "d"), OD, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} OD pairs with demand have no path")
    step = links.where(C("u") != C("v")).select("u", "v", "idx", C(weight).cast("double").alias("_w"))
    way = salted_join(step, ahead.select(C("node").alias("v"), "d", C("dist").alias("_on")), ["v"])
    text = F.concat(C("v").cast("string"), F.lit("/"))
    # a way on is nearer, or as near and its node the less, so that no flow turns in a circle
    way = way.join(ahead.select(C("node").alias("u"), "d", C("dist").alias("_own")), ["u", "d"])
    way = way.where((C("_on") < C("_own")) | ((C("_on") == C("_own")) & (C("v") < C("u"))))
    tree = pin(way.groupBy("u", "d").agg(F.min(F.struct(
        F.round(C("_w") + C("_on"), 9).alias("c"), text.alias("t"), "idx", "v")).alias("_b")).select(
        "u", "d", C("_b.v").alias("v"), C("_b.idx").alias("idx")))
    at = pin(od.select(C("o").alias("u"), "d", "q"))
    moved = None
    while True:
        on = at.join(tree, ["u", "d"], "left")
        now = on.groupBy(*LINK).agg(F.sum("q").alias("x"))
        moved = pin(now if moved is None else moved.unionByName(now).groupBy(*LINK).agg(F.sum("x").alias("x")))
        at = pin(on.where(C("v").isNotNull() & (C("v") != C("d"))).groupBy(C("v").alias("u"), "d").agg(
            F.sum("q").alias("q")))
        if at.isEmpty():
            return moved


def all_or_nothing(links: DataFrame, od: DataFrame, weight: str = "weight",
                   cutoff: int | None = None, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Each OD's demand on its cheapest path: link flows, and the total cost (one row).

    Demand flows down the tree of its destination and no path is listed, so ties cost nothing.
    Demand without a path, or with none of ``cutoff`` links if that is given, is an error.
    """
    wanted = od.where((C("q") > 0) & (C("o") != C("d")))
    if cutoff is not None:
        best = k_shortest(links, wanted, 1, weight, cutoff)
        loaded = wanted.join(best.select(*OD, "segs"), OD, "left")
        amount = F.when(C("segs").isNull(), 1.0).otherwise(C("q")).alias("q")
        flow = loaded.select(F.explode_outer("segs").alias("seg"), amount).select("seg.*", "q").groupBy(*LINK).agg(
            F.sum("q").alias("x"))
    else:
        held = _held_routes(links, weight, rows)
        flow = _load_in_tasks(held, wanted) if held is not None else _load_by_rounds(links, wanted, weight)
    flow = pin(flow.groupBy(*LINK).agg(F.sum("x").alias("x")))
    lost = flow.where(C("u").isNull()).first()
    if lost:
        raise ValueError(f"{lost['x']:.0f} OD pairs with demand have no path")
    flows = links.select(*LINK, C(weight).alias("_w")).join(flow, LINK, "left").na.fill(0.0, ["x"])
    return flows.drop("_w"), flows.agg(F.sum(C("_w") * C("x")).alias("sptt"))


def column_generation(links: DataFrame, paths: DataFrame, od: DataFrame, k: int,
                      weight: str = "weight", share: float = 1.0, block: int = 0,
                      cutoff: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Add new cheap paths for a demand-ordered share of the ODs.

    Returns all paths with an ``added`` flag, and counts of generated and new paths.
    """
    sample = sample_by_demand(od, share, block)
    made = pin(k_shortest(links, sample, k, weight, cutoff).drop("cost"))
    fresh = pin(new_paths(made, paths))
    keep = ["path_id", *OD, "nodes", "segs"]
    out = paths.select(*keep).withColumn("added", F.lit(0)).unionByName(
        fresh.select(*keep).withColumn("added", F.lit(1)))
    tally = scalar_join(made.agg(F.count(F.lit(1)).alias("n_generated")),
                        {"n_added": F.count(F.lit(1))}, fresh)
    return out, tally


def path_size_factors(paths: DataFrame) -> DataFrame:
    """Sum over a path's links of 1 / (links of the path * paths of the OD on the link)."""
    hops = paths.select("path_id", *OD, F.size("segs").alias("_len"),
                        F.explode("segs").alias("seg")).select("path_id", *OD, "_len", "seg.*")
    used = hops.groupBy(*OD, *LINK).agg(F.count(F.lit(1)).alias("_n"))
    both = salted_join(hops, used, [*OD, *LINK])
    return both.groupBy("path_id", *OD).agg(
        F.sum(1.0 / (C("_len") * C("_n"))).alias("path_size"))


def path_size_utility(sizes: DataFrame, factor: float = 1.0) -> DataFrame:
    return sizes.withColumn("v_path", F.lit(float(factor)) * F.log("path_size"))


def top_paths(paths: DataFrame, k: int, p: str = "p") -> DataFrame:
    """The k most probable paths of each OD; map tasks drop the rest before the shuffle."""
    w = Window.partitionBy(*OD).orderBy(C(p).desc(), C("path_id"))
    return paths.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


def diverse_paths(paths: DataFrame, k: int, weight: float, p: str = "p") -> DataFrame:
    """k paths per OD chosen one at a time by probability and dissimilarity.

    Score is (1 - weight) * p + weight * (1 - mean Jaccard similarity to the chosen).
    Every round scores each path once against the at most k chosen of its OD.
    """
    left = paths.select(*OD, "path_id", "nodes", p)
    chosen, rounds = None, []
    for i in range(k):
        score = F.lit(1.0 - weight) * C(p)
        if chosen is None:
            scored = left.withColumn("_s", score + F.lit(float(weight)))
        else:
            likeness = F.aggregate(
                F.transform("_sets", lambda s: jaccard(C("nodes"), s)), F.lit(0.0),
                lambda a, x: a + x) / F.size("_sets")
            scored = salted_join(left, chosen, OD)
            scored = scored.where(~F.array_contains("_ids", C("path_id"))).withColumn(
                "_s", score + F.lit(float(weight)) * (1 - likeness))
        best = scored.groupBy(*OD).agg(F.min(F.struct(
            (-F.round("_s", 12)).alias("s"), "path_id", "nodes")).alias("_b"))
        best = pin(best.select(*OD, C("_b.path_id").alias("path_id"), C("_b.nodes").alias("nodes"),
                               (-C("_b.s")).alias("score"), F.lit(i + 1).alias("rank")))
        rounds.append(best)
        one = best.select(*OD, F.array("path_id").alias("_ids1"), F.array("nodes").alias("_sets1"))
        if chosen is None:
            chosen = one.withColumnsRenamed({"_ids1": "_ids", "_sets1": "_sets"})
        else:
            chosen = chosen.join(one, OD, "left").select(
                *OD, F.concat("_ids", F.coalesce("_ids1", F.array().cast("array<string>")))
                .alias("_ids"),
                F.when(C("_sets1").isNull(), C("_sets")).otherwise(F.concat("_sets", "_sets1"))
                .alias("_sets"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.drop("nodes")


# demand --------------------------------------------------------------------------------

def scale_demand(od: DataFrame, factor: float) -> DataFrame:
    return od.withColumn("q", C("q") * F.lit(float(factor)))


def update_demand(od: DataFrame, q: DataFrame) -> DataFrame:
    """New demand for the ODs listed in ``q``; the others keep theirs."""
    new = q.select(*OD, C("q").alias("_q"))
    return od.join(new, OD, "left").withColumn("q", F.coalesce("_q", "q")).drop("_q")


def best_parallel(links: DataFrame, utility: str = "v_link") -> DataFrame:
    """Utility per node pair for the path search; of parallel links the best."""
    return links.groupBy("u", "v").agg(F.max(utility).alias(utility))


def fixed_effects(links: DataFrame, picked: DataFrame, kind: str = "links") -> DataFrame:
    """0/1 features for picked links or OD pairs (``links``), or node pairs (``nodes``).

    Long form: one row (u, v, feature) per link with a nonzero feature. ``nodes`` ignores
    direction.
    """
    if kind == "links":
        marks = picked.select("u", "v", F.format_string("l%d-%d", "u", "v").alias("feature"))
    else:
        lo, hi = F.least("u", "v"), F.greatest("u", "v")
        pair = picked.select(lo.alias("lo"), hi.alias("hi")).distinct()
        name = F.format_string("n%d,n%d", C("hi"), C("lo")).alias("feature")
        marks = pair.select(F.explode(F.array(
            F.struct(C("lo").alias("u"), C("hi").alias("v"), name),
            F.struct(C("hi").alias("u"), C("lo").alias("v"), name))).alias("m")).select("m.*")
    return lookup(links.select("u", "v"), marks.distinct(), ["u", "v"], "inner").withColumn(
        "value", F.lit(1))


def fixed_effect_columns(links: DataFrame, effects: DataFrame, features: Sequence[str]
                         ) -> DataFrame:
    """Listed fixed-effect features as 0/1 columns of the link table."""
    wide = effects.groupBy("u", "v").agg(*[
        F.max(F.when(C("feature") == f, 1).otherwise(0)).alias(f) for f in features])
    return lookup(links, wide, ["u", "v"]).na.fill(0, list(features))
