"""Link and path table queries: incidence, path search, choice sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import network as nw
from ..operators import sampling as sm
from .bindings import network, table, with_views
from .common import r, rounded
from .linkdata import _rank_sql
from .registry import query

C = F.col

# whole-number weights, so that equal costs are equal in every order of adding
_W = "round(10 * (tf + c))"
# all simple paths of up to two links, for DuckDB
L1 = f"SELECT u AS o, v AS d, u || '/' || v AS path_id, {_W} AS cost FROM links WHERE u <> v"
L2 = f"""
SELECT a.u AS o, b.v AS d, a.u || '/' || a.v || '/' || b.v AS path_id, a.w + b.w AS cost
FROM (SELECT u, v, {_W} AS w FROM links WHERE u <> v) a JOIN (SELECT u, v, {_W} AS w FROM links WHERE u <> v) b
  ON a.v = b.u AND a.u <> b.v"""
L3 = f"""
SELECT a.o, l.v AS d, a.path_id || '/' || l.v AS path_id, a.cost + {_W} AS cost
FROM ({L2}) a JOIN links l ON l.u = a.d AND l.u <> l.v AND NOT list_contains(string_split(a.path_id, '/'), CAST(l.v AS VARCHAR))"""
ALL2 = f"SELECT * FROM ({L1} UNION ALL {L2})"
ALL3 = f"SELECT * FROM ({L1} UNION ALL {L2} UNION ALL {L3})"
RANKED = """
SELECT p.*, row_number() OVER (PARTITION BY p.o, p.d ORDER BY round(p.cost, 9), p.path_id) AS rk
FROM walks p JOIN od ON od.o = p.o AND od.d = p.d"""


def _cheap_walks(k: int, ods: str, weight: str = _W) -> dict[str, str]:
    """DuckDB: all simple paths that may be among the ``k`` cheapest of an OD, of any length.

    Paths of up to two links bound the cost; a partial path goes on while it can stay within
    that by the cheapest way ahead (of any length, by doubling). ODs with fewer short paths
    have no bound.
    """
    short = f"""
SELECT u AS o, v AS d, w AS cost FROM wl UNION ALL
SELECT a.u, b.v, a.w + b.w FROM wl a JOIN wl b ON a.v = b.u AND a.u <> b.v"""
    limit = f"""
SELECT p.o, p.d, list_sort(list(s.cost))[{k}] AS most FROM {ods} p JOIN short s ON s.o = p.o AND s.d = p.d
WHERE p.o <> p.d GROUP BY p.o, p.d"""
    first = "SELECT u AS o, v AS d, min(w) AS c FROM wl GROUP BY u, v"
    double = "SELECT o, d, min(c) AS c FROM (SELECT * FROM {0} UNION ALL SELECT x.o, y.d, x.c + y.c FROM {0} x JOIN {0} y ON x.d = y.o WHERE x.o <> y.d) GROUP BY o, d"
    grown = """
SELECT * FROM (WITH RECURSIVE g AS (
  SELECT p.o, p.d, most, p.o AS here, CAST(p.o AS VARCHAR) AS path_id, [p.o] AS seen, 0::DOUBLE AS cost
  FROM %s p LEFT JOIN bound b ON b.o = p.o AND b.d = p.d WHERE p.o <> p.d
  UNION ALL
  SELECT g.o, g.d, most, l.v, path_id || '/' || l.v, list_append(seen, l.v), cost + l.w
  FROM g JOIN wl l ON l.u = g.here AND g.here <> g.d AND NOT list_contains(seen, l.v)
  LEFT JOIN m32 h ON h.o = l.v AND h.d = g.d
  WHERE l.v = g.d OR cost + l.w + h.c <= coalesce(most, 1e300) + 1e-9)
SELECT o, d, path_id, cost FROM g WHERE here = d AND cost <= coalesce(most, 1e300) + 1e-9)""" % ods
    return {"wl": f"SELECT u, v, {weight} AS w FROM links WHERE u <> v", "short": short, "bound": limit, "m1": first,
            **{f"m{2 * n}": double.format(f"m{n}") for n in (1, 2, 4, 8, 16)}, "walks": grown}


def weighted(net):
    return net.links.withColumn("weight", F.round(10 * (C("tf") + C("c"))))


@query("N01_adjacency", with_views(
    "SELECT o AS u, d AS v, count(*) AS n FROM trip GROUP BY o, d", "trip"))
def n01(spark, sf):
    return nw.adjacency(network(spark, sf).trip.select(C("o").alias("u"), C("d").alias("v")))


@query("N02_link_keys", with_views(
    "SELECT o AS u, d AS v, CAST(unnest(range(CAST(q AS BIGINT))) AS VARCHAR) AS idx FROM od", "od"))
def n02(spark, sf):
    adj = network(spark, sf).od.select(C("o").alias("u"), C("d").alias("v"),
                                       C("q").cast("long").alias("n"))
    return nw.link_keys(adj)


@query("N03_link_path", with_views(
    "SELECT path_id, o, d, CAST(seq AS INTEGER) - 0 AS seq, u, v FROM link_path", "link_path"))
def n03(spark, sf):
    return nw.hop_rows(network(spark, sf).paths).select("path_id", "o", "d", "seq", "u", "v")


@query("N04_od_incidence", with_views("SELECT DISTINCT o, d, path_id FROM path_trips", "path_trips"))
def n04(spark, sf):
    return nw.od_incidence(network(spark, sf).paths)


@query("N05_choice_set_sizes", with_views(
    "SELECT o, d, count(*) AS n_paths FROM path_trips GROUP BY o, d", "path_trips"))
def n05(spark, sf):
    return nw.choice_set_sizes(network(spark, sf).paths)


@query("N06_choice_set_members", with_views("""
SELECT o, d, path_id, row_number() OVER (PARTITION BY o, d ORDER BY path_id) AS pos,
       count(*) OVER (PARTITION BY o, d) AS n_paths FROM path_trips""", "path_trips"))
def n06(spark, sf):
    return nw.choice_set_members(network(spark, sf).paths)


@query("N16_load_paths", with_views("""
SELECT (SELECT count(*) FROM path_trips) AS paths, (SELECT count(*) FROM link_path) AS link_path,
       (SELECT count(*) FROM od) AS choice_sets""", "link_path", "od"))
def n16(spark, sf):
    parts = nw.load_paths(network(spark, sf).paths)
    out = None
    for name in ("paths", "link_path", "choice_sets"):
        one = parts[name].agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
        out = one if out is None else out.join(one, "_one")
    return out.drop("_one")


@query("N17_build_network", """
SELECT u, v, min(idx) AS idx FROM (
  SELECT c_nationkey AS u, CAST((c_custkey * 7) % 25 AS INTEGER) AS v, c_mktsegment AS idx FROM customer)
WHERE u <> v GROUP BY u, v""")
def n17(spark, sf):
    edges = table(spark, sf, "customer").select(
        C("c_nationkey").alias("u"), ((C("c_custkey") * 7) % 25).cast("int").alias("v"),
        C("c_mktsegment").alias("idx")).distinct()
    out, _ = nw.build_network(edges, parallel=False)
    return out


@query("N18_hops_by_lead", with_views(
    "SELECT path_id, CAST(seq AS INTEGER) - 0 AS seq, u, v FROM link_path", "link_path"))
def n18(spark, sf):
    nodes = network(spark, sf).paths.select("path_id", F.posexplode("nodes").alias("seq", "node"))
    return nw.hops_by_lead(nodes)


@query("N18_links_from", with_views("SELECT u, v FROM links WHERE u IN (3, 7)", "links"))
def n18_from(spark, sf):
    return nw.links_from(network(spark, sf).links, [3, 7]).select("u", "v")


@query("W10_link_position", with_views(
    "SELECT path_id, u, v, CAST(seq AS INTEGER) + 1 AS position FROM link_path", "link_path"))
def w10(spark, sf):
    return nw.hop_rows(network(spark, sf).paths).select("path_id", "u", "v",
                                                        (C("seq") + 1).alias("position"))


@query("N07_enumerate_paths", with_views(
    f"SELECT path_id, w.o, w.d, {r('cost', 'cost')} FROM walks w JOIN od ON od.o = w.o AND od.d = w.d AND od.q > 2",
    "links", "od", walks=ALL3))
def n07(spark, sf):
    net = network(spark, sf)
    out = nw.enumerate_paths(weighted(net), 3, net.od.where("q > 2"), "weight")
    return rounded(out.select("path_id", "o", "d", "cost"))


@query("N08_k_shortest", with_views(
    f"SELECT path_id, o, d, {r('cost', 'cost')} FROM ({RANKED}) WHERE rk <= 3",
    "links", "od", **_cheap_walks(3, "od")))
def n08(spark, sf):
    net = network(spark, sf)
    return rounded(nw.k_shortest(weighted(net), net.od, 3).select(
        "path_id", "o", "d", "cost"))


@query("N08_k_shortest_retry", with_views(
    f"SELECT path_id, o, d, {r('cost', 'cost')} FROM ({RANKED}) WHERE rk <= 2",
    "links", "od", walks=ALL2))
def n08_retry(spark, sf):
    net = network(spark, sf)
    out = nw.k_shortest_retry(weighted(net), net.od, 2, cutoff=1, factor=2, attempts=2)
    return rounded(out.select("path_id", "o", "d", "cost"))


@query("T05_k_shortest_by_links", with_views(
    f"SELECT path_id, o, d, cost FROM ({RANKED}) WHERE rk <= 4", "links", "od", **_cheap_walks(4, "od", "1::DOUBLE")))
def t05(spark, sf):
    net = network(spark, sf)
    out = nw.k_shortest(net.links.withColumn("weight", F.lit(1.0)), net.od, 4)
    return out.select("path_id", "o", "d", "cost")


_BEST_HOPS = """
SELECT q, cost, CAST(parts[i] AS INTEGER) AS u, CAST(parts[i + 1] AS INTEGER) AS v FROM (
  SELECT *, unnest(range(1, len(parts))) AS i FROM (
    SELECT b.*, od.q, string_split(b.path_id, '/') AS parts FROM best b
    JOIN od ON od.o = b.o AND od.d = b.d))"""


# cheapest paths of any length: each step doubles the links a path may have
_W1 = """
SELECT o, d, min({'cost': cost, 'path': path_id}) AS b FROM (
  SELECT u AS o, v AS d, round(10 * (tf + c)) AS cost, concat_ws('/', CAST(u AS VARCHAR), CAST(v AS VARCHAR)) AS path_id
  FROM links WHERE u <> v) GROUP BY o, d"""


def _doubled(w: str) -> str:
    return f"""
SELECT o, d, min(b) AS b FROM (SELECT * FROM {w} UNION ALL
  SELECT x.o, y.d, {{'cost': x.b.cost + y.b.cost, 'path': x.b.path || substr(y.b.path, instr(y.b.path, '/'))}} AS b
  FROM {w} x JOIN {w} y ON x.d = y.o WHERE x.o <> y.d) GROUP BY o, d"""


_CHEAPEST = {"w1": _W1, "w2": _doubled("w1"), "w4": _doubled("w2"), "w8": _doubled("w4"),
             "w16": _doubled("w8"), "w32": _doubled("w16"),
             "best": "SELECT w.o, w.d, w.b.cost AS cost, w.b.path AS path_id FROM w32 w "
                     "JOIN od ON od.o = w.o AND od.d = w.d"}


@query("N13_all_or_nothing", with_views(f"""
SELECT l.u, l.v, {r("coalesce(h.x, 0)", "x")} FROM links l LEFT JOIN (
  SELECT u, v, sum(q) AS x FROM hops GROUP BY u, v) h ON h.u = l.u AND h.v = l.v""",
    "links", "od", **_CHEAPEST, hops=_BEST_HOPS))
def n13(spark, sf):
    net = network(spark, sf)
    flows, _ = nw.all_or_nothing(weighted(net), net.od)
    return rounded(flows.select("u", "v", "x"))


@query("N13_total_cost", with_views(f"""
SELECT {r("sum(best.cost * od.q)", "sptt", 3)} FROM best JOIN od ON od.o = best.o AND od.d = best.d""",
    "links", "od", **_CHEAPEST))
def n13_cost(spark, sf):
    net = network(spark, sf)
    return rounded(nw.all_or_nothing(weighted(net), net.od)[1], 3)


_SAMPLE = """
SELECT o, d FROM (SELECT *, row_number() OVER (ORDER BY q DESC, o, d) AS pos, count(*) OVER () AS n FROM od)
WHERE pos <= ceil(0.3 * n)"""
_MADE = RANKED.replace("JOIN od ON", "JOIN picked od ON")


@query("N09_column_generation", with_views("""
SELECT path_id, o, d, 0 AS added FROM path_trips UNION ALL
SELECT path_id, o, d, 1 FROM made m
WHERE rk <= 2 AND NOT EXISTS (SELECT 1 FROM path_trips p WHERE p.path_id = m.path_id)""",
    "links", "od", "path_trips", picked=_SAMPLE, **_cheap_walks(2, "picked"), made=_MADE))
def n09(spark, sf):
    net = network(spark, sf)
    out, _ = nw.column_generation(weighted(net), net.paths, net.od, 2, share=0.3)
    return out.select("path_id", "o", "d", "added")


@query("N09_generation_counts", with_views("""
SELECT count(*) AS n_generated,
       count(CASE WHEN NOT EXISTS (SELECT 1 FROM path_trips p WHERE p.path_id = m.path_id) THEN 1 END) AS n_added
FROM made m WHERE rk <= 2""", "links", "od", "path_trips", picked=_SAMPLE, **_cheap_walks(2, "picked"), made=_MADE))
def n09_counts(spark, sf):
    net = network(spark, sf)
    return nw.column_generation(weighted(net), net.paths, net.od, 2, share=0.3)[1]


_PS = """
SELECT path_id, sum(1.0::DOUBLE / (n_links * n)) AS path_size FROM (
  SELECT *, count(*) OVER (PARTITION BY o, d, u, v) AS n FROM link_path) GROUP BY path_id"""


@query("N10_path_size", with_views(f"SELECT path_id, {r('path_size', 'path_size')} FROM ps",
                                   "link_path", ps=_PS))
def n10(spark, sf):
    return rounded(nw.path_size_factors(network(spark, sf).paths).select("path_id", "path_size"))


@query("N11_path_size_utility", with_views(
    f"SELECT path_id, {r('0.7::DOUBLE * ln(path_size)', 'v_path')} FROM ps", "link_path", ps=_PS))
def n11(spark, sf):
    sizes = nw.path_size_factors(network(spark, sf).paths)
    return rounded(nw.path_size_utility(sizes, 0.7).select("path_id", "v_path"))


@query("N12_update_demand", with_views(f"""
SELECT od.o, od.d, {r("coalesce(n.load / 2, od.q * 1.1::DOUBLE)", "q")}
FROM od LEFT JOIN links n ON n.u = od.o AND n.v = od.d AND n.load > 50""", "od", "links"))
def n12(spark, sf):
    net = network(spark, sf)
    new = net.links.where("load > 50").select(C("u").alias("o"), C("v").alias("d"),
                                              (C("load") / 2).alias("q"))
    return rounded(nw.update_demand(nw.scale_demand(net.od, 1.1), new))


_PICKED = ("SELECT u, v FROM (" + _rank_sql("links", "u", "v") + ") WHERE pos <= floor(0.1 * n)")


@query("N14_fixed_effects_links", with_views(
    "SELECT u, v, 'l' || u || '-' || v AS feature, 1 AS value FROM picked", "links", picked=_PICKED))
def n14(spark, sf):
    links = network(spark, sf).links
    return nw.fixed_effects(links, sm.random_share(links, ["u", "v"], 0.1, 5, [31, 17]))


@query("N14_fixed_effects_nodes", with_views("""
SELECT l.u, l.v, 'n' || p.hi || ',n' || p.lo AS feature, 1 AS value FROM links l
JOIN (SELECT DISTINCT least(u, v) AS lo, greatest(u, v) AS hi FROM picked) p
  ON p.lo = least(l.u, l.v) AND p.hi = greatest(l.u, l.v)""", "links", picked=_PICKED))
def n14_nodes(spark, sf):
    links = network(spark, sf).links
    return nw.fixed_effects(links, sm.random_share(links, ["u", "v"], 0.1, 5, [31, 17]), "nodes")


@query("N14_fixed_effect_columns", with_views(
    "SELECT u, v, CASE WHEN u = 3 AND v = 7 THEN 1 ELSE 0 END AS \"l3-7\", "
    "CASE WHEN u = 7 AND v = 3 THEN 1 ELSE 0 END AS \"l7-3\" FROM links", "links"))
def n14_columns(spark, sf):
    links = network(spark, sf).links
    picked = links.where("(u = 3 AND v = 7) OR (u = 7 AND v = 3)")
    out = nw.fixed_effect_columns(links, nw.fixed_effects(links, picked), ["l3-7", "l7-3"])
    return out.select("u", "v", "l3-7", "l7-3")


@query("J11_new_paths", with_views("""
SELECT path_id, w.o, w.d FROM walks w JOIN od ON od.o = w.o AND od.d = w.d
WHERE NOT EXISTS (SELECT 1 FROM path_trips p WHERE p.path_id = w.path_id)""",
    "links", "od", "path_trips", walks=ALL2))
def j11(spark, sf):
    net = network(spark, sf)
    return jn.new_paths(nw.enumerate_paths(net.links, 2, net.od), net.paths).select("path_id", "o", "d")


@query("J12_path_links", with_views(
    "SELECT path_id, CAST(seq AS INTEGER) - 0 AS seq, u, v FROM link_path", "link_path"))
def j12(spark, sf):
    net = network(spark, sf)
    return jn.path_links(net.paths, net.links).select("path_id", "seq", "u", "v")


_SIM = "len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))"


@query("J13_overlap_with_best", with_views(f"""
SELECT path_id, {r(_SIM, "jaccard")} FROM (
  SELECT p.path_id, string_split(p.path_id, '/') AS a, string_split(t.path_id, '/') AS b
  FROM path_trips p JOIN (
    SELECT o, d, path_id, row_number() OVER (PARTITION BY o, d ORDER BY trips DESC, path_id) AS rk
    FROM path_trips) t ON t.o = p.o AND t.d = p.d AND t.rk = 1)""", "path_trips"))
def j13(spark, sf):
    paths = network(spark, sf).paths
    best = nw.top_paths(paths, 1, "trips").select(
        "o", "d", C("path_id").alias("chosen_id"), C("nodes").alias("chosen_nodes"))
    return rounded(jn.overlap_with(paths, best).select("path_id", "jaccard"))


@query("T01_top_paths", with_views("""
SELECT path_id, o, d, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY trips DESC, path_id) AS rk FROM path_trips)
WHERE rk <= 4""", "path_trips"))
def t01(spark, sf):
    return nw.top_paths(network(spark, sf).paths, 4, "trips").select("path_id", "o", "d", "rank")


_SHARE = """
SELECT path_id, o, d, string_split(path_id, '/') AS nodes,
       trips / sum(trips) OVER (PARTITION BY o, d) AS p FROM path_trips"""


def _pick(n: int) -> str:
    likes = [f"(len(list_intersect(s.nodes, c{i}.nodes)) / len(list_distinct(list_concat(s.nodes, c{i}.nodes))))"
             for i in range(1, n)]
    score = ("0.6::DOUBLE * s.p + 0.4::DOUBLE" if n == 1 else
             f"0.6::DOUBLE * s.p + 0.4::DOUBLE * (1 - (0.0::DOUBLE + {' + '.join(likes)}) / {n - 1})")
    # an OD with fewer paths than rounds keeps the ones it chose
    joins = " ".join(f"JOIN c{i} ON c{i}.o = s.o AND c{i}.d = s.d" for i in range(1, n))
    skip = " AND ".join(f"s.path_id <> c{i}.path_id" for i in range(1, n)) or "true"
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY score DESC, path_id) AS rk FROM (
  SELECT s.path_id, s.o, s.d, s.nodes, round({score}, 12) AS score FROM sh s {joins} WHERE {skip}))
WHERE rk = 1"""


@query("T02_diverse_paths", with_views(
    " UNION ALL ".join(f"SELECT path_id, o, d, {r('score', 'score')}, {i} AS rank FROM c{i}"
                       for i in (1, 2, 3)), "path_trips",
    sh=_SHARE, c1=_pick(1), c2=_pick(2), c3=_pick(3)))
def t02(spark, sf):
    paths = network(spark, sf).paths
    total = paths.groupBy("o", "d").agg(F.sum("trips").alias("_t"))
    paths = paths.join(total, ["o", "d"]).withColumn("p", C("trips") / C("_t"))
    return rounded(nw.diverse_paths(paths, 3, 0.4).select("path_id", "o", "d", "score", "rank"))
