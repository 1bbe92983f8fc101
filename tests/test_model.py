import heapq
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import networks
from flowgrain.operators import network as nw
from flowgrain.plans import choice as ch
from flowgrain.plans import estimation as es
from flowgrain.plans import stats

THETA = {"tt": -1.0, "c": -0.4}


@pytest.fixture(scope="module")
def yang(spark):
    links, od = networks.yang(spark)
    paths = networks.yang_paths(spark)
    links = ch.predict(paths, links, od, THETA).withColumn(
        "count", F.when((F.col("u") + F.col("v")) % 4 != 0, F.col("x") * 1.1 + 3)).drop("x")
    return links.cache(), od.cache(), paths.cache()


def test_toy_hand_numbers(spark):
    links, od = networks.toy(spark)
    paths = nw.enumerate_paths(links, 3, od)
    flows = ch.path_flows(ch.path_utility(paths, links, {"tt": -1.0}), od)
    p = {r["path_id"]: r["p"] for r in flows.where("o = 3").collect()}
    assert sorted(round(v, 6) for v in p.values()) == [0.268941, 0.731059]
    x = {(r["u"], r["v"], r["idx"]): r["x"]
         for r in ch.link_flows(paths, links, flows).collect()}
    assert math.isclose(x[(3, 4, "0")], 1096.588, abs_tol=1e-3)
    assert math.isclose(x[(3, 4, "1")], 403.412, abs_tol=1e-3)
    assert x[(1, 3, "0")] == pytest.approx(500) and x[(2, 3, "0")] == pytest.approx(500)


def test_probabilities_and_flows_add_up(yang):
    links, od, paths = yang
    flows = ch.path_flows(ch.path_utility(paths, links, THETA), od)
    sums = flows.groupBy("o", "d").agg(F.sum("p").alias("p"), F.sum("f").alias("f"),
                                       F.max("q").alias("q")).collect()
    assert len(sums) == 9
    for r in sums:
        assert r["p"] == pytest.approx(1.0) and r["f"] == pytest.approx(r["q"])


def test_many_utilities_agree_with_one(yang):
    links, od, paths = yang
    v = ch.path_utility(paths, links, THETA).withColumn("w", F.col("v") * 3 - 700)
    both = ch.probabilities(v, {"p": "v", "r": "w"}).collect()
    one = {r["path_id"]: r["p"] for r in ch.probabilities(v, {"p": "v"}).collect()}
    two = {r["path_id"]: r["r"] for r in ch.probabilities(v, {"r": "w"}).collect()}
    for r in both:
        assert r["p"] == pytest.approx(one[r["path_id"]], rel=1e-12)
        assert r["r"] == pytest.approx(two[r["path_id"]], rel=1e-9)


def test_path_size_enters_response_and_candidates(yang):
    links, od, paths = yang
    want = {(r["u"], r["v"]): r["x"] for r in ch.predict(paths, links, od, THETA, 1.5).collect()}
    resp = es.response(paths, links, od, THETA, path_size=1.5)
    (_, cand), = es.flows_at(paths, links, od, [THETA], path_size=1.5)
    for df, col in ((resp, "x"), (cand, "flow_0")):
        got = {(r["u"], r["v"]): r[col] for r in df.collect()}
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def _loss(yang, theta):
    links, od, paths = yang
    return es.loss(ch.predict(paths, links, od, theta)).first()["sse"]


def test_gradient_and_hessian_equal_differences(yang):
    links, od, paths = yang
    theta = {"tt": -0.7, "c": -0.2}
    resp = es.response(paths, links, od, theta, second=True)
    grad, hess = es.gradient(resp, list(theta)).first(), es.diagonal_hessian(resp, list(theta)).first()
    for k in theta:
        h = 1e-4
        up, mid, down = (_loss(yang, {**theta, k: theta[k] + s}) for s in (h, 0.0, -h))
        assert grad[f"g_{k}"] == pytest.approx((up - down) / (2 * h), rel=1e-5)
        assert hess[f"h_{k}"] == pytest.approx((up - 2 * mid + down) / (h * h), rel=1e-3)


def test_grid_scan_agrees_with_response(yang):
    links, od, paths = yang
    grid = [-1.5, -0.7, 0.0]
    rows = es.grid_scan(paths, links, od, THETA, "tt", grid).collect()
    for r in rows:
        at = {**THETA, "tt": grid[r["candidate"]]}
        resp = es.response(paths, links, od, at, second=True)
        one = es.normal_sums(resp, ["tt"]).first()
        assert r["sse"] == pytest.approx(one["sse"]) and r["jj"] == pytest.approx(one["jj_tt_tt"])
        assert r["gradient"] == pytest.approx(2 * one["jr_tt"])
        assert r["hessian"] == pytest.approx(es.diagonal_hessian(resp, ["tt"]).first()["h_tt"])


@pytest.mark.parametrize("search", ["grid", "bisection"])
def test_objective_never_falls_with_line_search(yang, search):
    links, od, paths = yang
    eq = ch.equilibrium(paths, links, od, THETA, iters=3, method="fw", search=search, accuracy=0.0,
                        points=11)
    obj = [r["objective"] for r in eq.log]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(obj, obj[1:])) or search == "bisection"
    x = eq.links.agg(F.sum(F.when(F.col("u").isin(1, 2, 4), F.col("x")))).first()[0]
    assert x > 0
    again = ch.link_flows(paths, links, eq.flows).select("u", "v", F.col("x").alias("y"))
    gap = eq.links.join(again, ["u", "v"]).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    assert gap < 1e-6


def test_estimation_finds_the_weights(spark):
    links, od = networks.yang(spark)
    paths = networks.yang_paths(spark)
    truth = {"tt": -0.8, "c": -0.5}
    links = ch.predict(paths, links, od, truth).withColumnRenamed("x", "count")
    fit = es.estimate(paths, links, od, {"tt": -0.3, "c": 0.0}, iters=8, method="lm",
                      signs={"tt": "-"})
    assert fit.objective < 1.0
    assert fit.theta["tt"] == pytest.approx(-0.8, abs=0.02)
    assert fit.theta["c"] == pytest.approx(-0.5, abs=0.05)
    assert [r["iter"] for r in fit.log] == list(range(1, 9))


def test_fixed_features_stay(yang):
    links, od, paths = yang
    _, steps = es.step_candidates(paths, links, od, {"tt": -0.5, "c": -0.1}, "gauss-newton",
                                  fixed=["c"])
    assert steps[0]["c"] == -0.1 and steps[0]["tt"] != -0.5


def test_inference_tables(yang):
    links, od, paths = yang
    fit, tests, model = es.infer(paths, links, od, {"tt": -0.5, "c": 0.0}, iters=4)
    rows = {r["parameter"]: r for r in tests.collect()}
    assert set(rows) == {"tt", "c"} and rows["tt"]["CI"].startswith("[")
    assert model["F"] > 0 and 0 <= model["p"] <= 1 and model["sse_m2"] <= model["sse_m1"]
    assert fit.objective == pytest.approx(model["sse_m2"], rel=1e-6)


def test_demand_step_moves_toward_counts(yang):
    links, od, paths = yang
    flows = ch.path_flows(ch.path_utility(paths, links, THETA), od)
    at = ch.link_flows(paths, links, flows)
    new = es.adjust_demand(paths, flows, at, od, od, weight=0.0, step=0.05)
    before = es.loss(at).first()["sse"]
    assert es.loss(ch.predict(paths, links, new, THETA)).first()["sse"] < before


def test_tails():
    # table values of the t and F distributions
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_critical(0.05, 10) == pytest.approx(2.2281, abs=1e-3)
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert stats.f_critical(0.05, 3, 20) == pytest.approx(3.0984, abs=1e-3)
    assert stats.f_upper(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("options", [{"cutoff": 8}, {}, {"rows": 0}])
def test_k_shortest_equals_enumeration(spark, k, options):
    links, od = networks.yang(spark)
    links = links.withColumn("weight", F.col("tf") + F.col("c"))
    w = {(r["u"], r["v"]): r["weight"] for r in links.collect()}
    got = {}
    for r in nw.k_shortest(links, od, k, **options).collect():
        got.setdefault((r["o"], r["d"]), []).append((round(r["cost"], 9), r["path_id"]))
    for e in networks.YANG_Q:
        o, d = int(e[0]), int(e[1])
        paths = networks.simple_paths(w, o, d, 8)
        cost = sorted((round(sum(w[a, b] for a, b in zip(p, p[1:])), 9), "/".join(map(str, p)))
                      for p in paths)
        assert sorted(got[o, d]) == cost[:k]


def test_all_or_nothing_conserves_demand(spark):
    links, od = networks.yang(spark)
    flows, total = nw.all_or_nothing(links.withColumn("weight", F.col("tf")), od, cutoff=8)
    into9 = flows.where("v = 9").agg(F.sum("x")).first()[0]
    assert into9 == pytest.approx(100 + 90 + 110)
    cost = flows.join(links, ["u", "v", "idx"]).agg(F.sum(F.col("x") * F.col("tf"))).first()[0]
    assert total.first()["sptt"] == pytest.approx(cost)


def test_path_size_is_one_without_overlap(spark):
    paths = nw.paths_from_nodes(spark.createDataFrame(
        [([1, 2, 4],), ([1, 3, 4],), ([1, 2, 3, 4],)], "nodes array<int>"))
    ps = {r["path_id"]: r["path_size"] for r in nw.path_size_factors(paths).collect()}
    assert ps["1/2/4"] == pytest.approx(0.5 * 0.5 + 0.5)
    assert ps["1/2/3/4"] == pytest.approx((0.5 + 1 + 0.5) / 3)


def test_diverse_paths_prefer_different_ones(spark):
    paths = nw.paths_from_nodes(spark.createDataFrame(
        [([1, 2, 3, 9],), ([1, 2, 4, 9],), ([1, 7, 8, 9],)], "nodes array<int>"))
    p = F.when(F.col("path_id") == "1/2/3/9", 0.5).when(F.col("path_id") == "1/2/4/9", 0.3).otherwise(0.2)
    paths = paths.withColumn("p", p)
    pick = lambda w: [r["path_id"] for r in nw.diverse_paths(paths, 2, w).orderBy("rank").collect()]
    assert pick(0.0) == ["1/2/3/9", "1/2/4/9"]
    assert pick(0.9) == ["1/2/3/9", "1/7/8/9"]


def test_retry_with_longer_cutoff(spark):
    links, od = networks.yang(spark)
    links = links.withColumn("weight", F.col("tf"))
    got = nw.k_shortest_retry(links, od, 2, cutoff=2, factor=2, attempts=3)
    n = {(r["o"], r["d"]): r["count"] for r in got.groupBy("o", "d").count().collect()}
    w = [(int(e[0]), int(e[1])) for e in networks.YANG]
    for e in networks.YANG_Q:
        o, d = int(e[0]), int(e[1])
        assert n[o, d] == min(2, len(networks.simple_paths(w, o, d, 8)))


def test_parallel_links_make_different_paths(spark):
    links, od = networks.toy(spark)
    got = nw.k_shortest(links.withColumn("weight", F.col("tf")), od, 2, cutoff=3)
    ids = [r["path_id"] for r in got.where("o = 1").orderBy("cost").collect()]
    assert ids == ["1/3/4", "1/3/4|0/1"]
    with pytest.raises(ValueError):
        ch.equilibrium(got, links, od, {"tt": -1.0}, method="nope")


def test_update_rules_agree_at_the_optimum(yang):
    jj, jr = np.array([[4.0, 1.0], [1.0, 3.0]]), np.array([2.0, -1.0])
    gn = es.UPDATES["gauss-newton"](jj, jr, np.zeros(2), 0.1, 0.0)
    lm = es.UPDATES["lm"](jj, jr, np.zeros(2), 0.1, 0.0)
    assert np.allclose(gn, lm) and np.allclose(jj @ gn, -jr)


def test_demand_far_away_is_loaded_without_a_hop_limit(spark):
    chain = networks.links(spark, [(i, i + 1, "0", 1.0 + i % 3) for i in range(24)], 100)
    chain = chain.withColumn("weight", F.col("tf"))
    od = spark.createDataFrame([(0, 24, 5.0), (20, 24, 2.0), (3, 4, 0.0)], "o int, d int, q double")
    flows, total = nw.all_or_nothing(chain, od)
    assert {r["u"]: r["x"] for r in flows.collect()} == {i: 5.0 if i < 20 else 7.0 for i in range(24)}
    far, near = (sum(1.0 + i % 3 for i in range(a, 24)) for a in (0, 20))
    assert total.first()["sptt"] == 5 * far + 2 * near
    with pytest.raises(ValueError, match="1 OD pairs"):
        nw.all_or_nothing(chain, spark.createDataFrame([(24, 0, 1.0)], "o int, d int, q double"))


def lattice(spark, n, weight=lambda a, b: 1.0):
    at = [(i, j) for i in range(n) for j in range(n)]
    edges = [(i * n + j, x * n + y) for i, j in at for x, y in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1))
             if 0 <= x < n and 0 <= y < n]
    rows = [(u, v, "0", weight(u, v)) for u, v in edges]
    return spark.createDataFrame(rows, "u int, v int, idx string, weight double"), {(u, v): w for u, v, _, w in rows}


def yen(w, o, d, k):
    """k cheapest simple paths by plain search over all of them up to the k-th cost."""
    near, heap, out = {}, [(0.0, d)], []
    while heap:
        c, n = heapq.heappop(heap)
        if n not in near:
            near[n] = c
            for (a, b), x in w.items():
                if b == n and a not in near:
                    heapq.heappush(heap, (c + x, a))
    heap = [(near[o], str(o), [o], 0.0)]
    while heap and len(out) < k:
        _, name, path, cost = heapq.heappop(heap)
        if path[-1] == d:
            out.append((round(cost, 9), name))
            continue
        for (a, b), x in w.items():
            if a == path[-1] and b not in path and b in near:
                heapq.heappush(heap, (round(cost + x + near[b], 9), name + "/" + str(b), [*path, b], cost + x))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_k_shortest_on_a_lattice_with_ties(spark, rows):
    links, w = lattice(spark, 4)
    pairs = [(0, 15), (3, 12), (5, 6), (15, 0)]
    od = spark.createDataFrame([(o, d, 1.0) for o, d in pairs], "o int, d int, q double")
    got = {}
    for r in nw.k_shortest(links, od, 6, rows=rows).collect():
        got.setdefault((r["o"], r["d"]), []).append((r["cost"], r["path_id"]))
        assert [s.u for s in r["segs"]] == r["nodes"][:-1] and [s.v for s in r["segs"]] == r["nodes"][1:]
    assert {p: sorted(x) for p, x in got.items()} == {(o, d): yen(w, o, d, 6) for o, d in pairs}


def test_large_lattice_is_searched_fast(spark):
    links, w = lattice(spark, 30, lambda a, b: 1.0 + (a * 7 + b * 13) % 5)
    flat, _ = lattice(spark, 30)
    r = random.Random(5)
    pairs = {(r.randrange(900), r.randrange(900)) for _ in range(100)} | {(0, 899)}
    od = spark.createDataFrame([(o, d, 1.0 + o % 3) for o, d in pairs if o != d], "o int, d int, q double")
    begin = time.time()
    got = nw.k_shortest(links, od, 3).collect()
    assert len(got) == 3 * od.count()
    assert nw.k_shortest(flat, od, 3).count() == 3 * od.count()
    assert time.time() - begin < 60
    for r in got:
        assert len(set(r["nodes"])) == len(r["nodes"])
        assert r["cost"] == sum(w[a, b] for a, b in zip(r["nodes"], r["nodes"][1:]))
    best = {p: yen(w, *p, 3) for p in sorted((r["o"], r["d"]) for r in got)[:1]}
    for p, want in best.items():
        assert sorted((r["cost"], r["path_id"]) for r in got if (r["o"], r["d"]) == p) == want
    flows, total = nw.all_or_nothing(flat, od)
    apart = sum((1.0 + o % 3) * (abs(o // 30 - d // 30) + abs(o % 30 - d % 30)) for o, d in pairs if o != d)
    assert total.first()["sptt"] == pytest.approx(apart)


def test_loading_in_tasks_and_by_rounds_agree(spark):
    links, w = lattice(spark, 5, lambda a, b: 1.0 + (a * 3 + b) % 3)
    od = spark.createDataFrame([(o, d, 1.0 + o) for o in range(0, 25, 3) for d in range(1, 25, 4) if o != d],
                               "o int, d int, q double")
    a, b = (nw.all_or_nothing(links, od, rows=rows) for rows in (200_000, 0))
    one, two = ({(r["u"], r["v"]): r["x"] for r in x[0].collect()} for x in (a, b))
    assert one == two and a[1].first()["sptt"] == pytest.approx(b[1].first()["sptt"])
    assert a[1].first()["sptt"] == pytest.approx(sum((1.0 + o) * yen(w, o, d, 1)[0][0] for o, d, _ in od.collect()))
    with pytest.raises(ValueError, match="1 OD pairs"):
        nw.all_or_nothing(links.where("v <> 24"), spark.createDataFrame([(0, 24, 1.0)], "o int, d int, q double"), rows=0)


@pytest.mark.parametrize("cutoff", [1, 2, 3, 5, 8])
def test_two_frontiers_find_all_paths_of_the_listed_pairs(spark, cutoff):
    links, od = networks.yang(spark)
    got = [(r["o"], r["d"], r["path_id"], [s.v for s in r["segs"]], round(r["cost"], 9)) for r in nw.enumerate_paths(
        links.withColumn("weight", F.col("tf") + F.col("c")), cutoff, od, "weight").collect()]
    w = {(r["u"], r["v"]): r["tf"] + r["c"] for r in links.collect()}
    want = [(int(o), int(d), "/".join(map(str, p)), p[1:], round(sum(w[x] for x in zip(p, p[1:])), 9))
            for o, d in networks.YANG_Q for p in networks.simple_paths(networks.YANG, o, d, cutoff)]
    assert sorted(got) == sorted(want)
