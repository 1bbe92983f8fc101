import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import networks
from flowgrain.catalog import model
from flowgrain.functions import scalars as fn
from flowgrain.operators import network as nw
from flowgrain.plans import choice as ch
from flowgrain.plans import estimation as es
from flowgrain.plans import learning as ln
from flowgrain.plans import searches as sr
from flowgrain.plans.generation import Generation, PathSet

THETA = {"tt": -1.0, "c": -0.4}


@pytest.fixture(scope="module")
def yang(spark):
    links, od = networks.yang(spark)
    paths = networks.yang_paths(spark)
    links = ch.predict(paths, links, od, THETA).withColumn(
        "count", F.when((F.col("u") + F.col("v")) % 4 != 0, F.col("x") * 1.1 + 3)).drop("x")
    return links.cache(), od.cache(), paths.cache()


def test_batched_equilibria_equal_single_runs(yang):
    links, od, paths = yang
    grid = sr.candidates([{"tt": -1.0, "c": -0.4}, {"tt": -0.3, "c": 0.0}], [1.0, 1.3])
    got = {r["candidate"]: r for r in sr.equilibria(paths, links, od, grid, iters=4, accuracy=1e-3, block=3).collect()}
    assert len(got) == 4
    for i, (theta, scale) in enumerate(grid):
        eq = ch.equilibrium(paths, links, nw.scale_demand(od, scale), theta, iters=4, method="msa", accuracy=1e-3)
        assert got[i]["sse"] == pytest.approx(es.loss(eq.links).first()["sse"], rel=1e-9)
        assert got[i]["iterations"] == len(eq.log) - 1
        assert got[i]["scale"] == scale and json.loads(got[i]["theta"]) == theta
    top = sr.best(sr.equilibria(paths, links, od, grid, iters=1)).first()
    assert top["candidate"] in got
    assert len(sr.random_candidates({"tt": (-1, 0)}, (0.8, 1.2), 5, 1)) == 5


def test_t_grid_equals_tests_at_each_point(yang):
    links, od, paths = yang
    grid = sr.candidates([THETA, {"tt": -0.5, "c": 0.0}], [1.0, 0.9])
    got = {(r["candidate"], r["parameter"]): r["t_test"] for r in sr.t_grid(paths, links, od, grid).collect()}
    for i, (theta, scale) in enumerate(grid):
        resp = es.response(paths, links, nw.scale_demand(od, scale), theta)
        for r in es.t_tests(resp, theta).collect():
            assert got[i, r["parameter"]] == pytest.approx(r["t_test"], rel=1e-8)


def test_large_means_keep_their_digits(spark):
    z = [1e6 + 0.001 * i for i in range(40)]
    rows = [(f"p{i}", 0, 1, x, -0.02 * i) for i, x in enumerate(z)]
    paths = spark.createDataFrame(rows, "path_id string, o int, d int, z double, v double")
    got = ch.choice_moments(paths, {"p": "v"}, ["z"], second=True).first()
    p = np.exp([r[4] for r in rows])
    p /= p.sum()
    away = np.array([0.001 * i for i in range(40)])
    assert got["var_p_z"] == pytest.approx((p * away**2).sum() - (p * away).sum() ** 2, rel=1e-6)


def test_own_performance_function_in_objective_slope_and_search(yang):
    links, od, paths = yang
    own = lambda x: F.col("tf") * (1 + F.exp(F.col(x) / 900.0 if isinstance(x, str) else x / 900.0) * 0.2)
    exact = fn.performance(own, lambda x: F.col("tf") * ((F.col(x) if isinstance(x, str) else x) + 180.0 * (
        F.exp((F.col(x) if isinstance(x, str) else x) / 900.0) - 1)))
    start = ch.path_flows(ch.path_utility(paths, links, THETA), od).select("path_id", "o", "d", F.col("f").alias("f1"))
    end = ch.path_flows(ch.path_utility(paths, links, {"tt": -0.2, "c": 0.0}), od).select("path_id", F.col("f").alias("f2"))
    flows = start.join(end, "path_id").cache()
    h = 1e-3
    for form in (own, exact):
        at = {r["lambda"]: r["objective"] for r in ch.fisk_scan(paths, links, flows, THETA, [0.4 - h, 0.4, 0.4 + h], form).collect()}
        slope = ch.fisk_slopes(paths, links, flows, THETA, [0.4], form).first()["slope"]
        assert slope == pytest.approx((at[0.4 + h] - at[0.4 - h]) / (2 * h), rel=1e-4)
    one = ch.fisk_objective(paths, links, flows, THETA, "f1", own).first()["objective"]
    assert one == pytest.approx(ch.fisk_objective(paths, links, flows, THETA, "f1", exact).first()["objective"], rel=1e-9)
    eq = ch.equilibrium(paths, links, od, THETA, iters=3, time_fn=own, accuracy=0.0)
    obj = [r["objective"] for r in eq.log]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(obj, obj[1:]))


def test_path_set_grows_and_shrinks(yang):
    links, od, paths = yang
    few = paths.join(paths.groupBy("o", "d").agg(F.min("path_id").alias("path_id")).select("path_id"), "path_id")
    rule = Generation(3, keep=2)
    eq = ch.equilibrium(few, links, od, THETA, iters=2, generation=rule)
    assert eq.log[0]["n_added"] > 0 and eq.log[0]["n_removed"] > 0 and len(eq.log) > 1
    sizes = {(r["o"], r["d"]): r["count"] for r in eq.flows.groupBy("o", "d").count().collect()}
    assert max(sizes.values()) == 2 and len(sizes) == len(networks.YANG_Q)
    best = ch.probabilities(ch.path_utility(paths, links, THETA), {"p": "v"})
    assert best.count() > eq.flows.count()
    total = eq.flows.agg(F.sum("f")).first()[0]
    assert total == pytest.approx(sum(networks.YANG_Q.values()))
    # a second round adds the paths that were left out and are cheap again, once
    more = ch.equilibrium(few, links, od, THETA, uncongested=True, generation=Generation(4), path_set=eq.paths, round_=1)
    ids = [r["path_id"] for r in more.paths.table().collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= {r["path_id"] for r in eq.flows.collect()}
    sizes = ch.equilibrium(few, links, od, THETA, uncongested=True, path_size=1.0, generation=Generation(2, keep=2, dissimilarity=0.5))
    assert sizes.flows.agg(F.sum("f")).first()[0] == pytest.approx(total)
    with pytest.raises(ValueError):
        Generation(2, sampling="else")


def test_sequential_and_random_sampling_cover_other_pairs(yang):
    links, od, paths = yang
    few = paths.join(paths.groupBy("o", "d").agg(F.min("path_id").alias("path_id")).select("path_id"), "path_id")
    at = links.withColumn("tt", F.col("tf"))
    touched = []
    for n in (0, 1):
        grown = PathSet.of(few)
        grown.grow(at, od, THETA, Generation(3, 0.4, "sequential"), n)
        touched.append({(r["o"], r["d"]) for r in grown.generations[-1].collect()})
    assert touched[0] and touched[1] and not touched[0] & touched[1]
    drawn = PathSet.of(few)
    assert drawn.grow(at, od, THETA, Generation(2, 0.5, "random"), 3)["n_generated"] <= 2 * od.count()


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on_where_it_was(yang, tmp_path, monkeypatch):
    links, od, paths = yang
    stages = [ln.Stage("first", 2, "ngd", 0.2), ln.Stage("second", 2, "lm", scale_steps=1, demand=(1.0, 1e-3))]
    start = {"tt": -0.4, "c": 0.0}
    whole = ln.learn(paths, links, od, start, stages, f"file:{tmp_path}/whole", signs={"tt": "-"}, informative=True)
    calls, kept = [], ln.equilibrium

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 4:
            raise Stopped
        return kept(*a, **k)
    monkeypatch.setattr(ln, "equilibrium", failing)
    folder = f"file:{tmp_path}/cut"
    with pytest.raises(Stopped):
        ln.learn(paths, links, od, start, stages, folder, signs={"tt": "-"}, informative=True)
    assert ln.iterations(links.sparkSession, folder).count() == 3
    again = ln.learn(paths, links, od, start, stages, folder, signs={"tt": "-"}, informative=True)
    assert len(calls) == 5
    assert again.theta == pytest.approx(whole.theta) and again.objective == pytest.approx(whole.objective)
    assert [r["stage"] for r in again.log] == ["first", "first", "second", "second"]
    for a, b in zip(again.log, whole.log):
        assert a == pytest.approx(b)
    assert whole.objective == min(r["objective"] for r in whole.log)


def test_growing_sets_are_restored(yang, tmp_path):
    links, od, paths = yang
    few = paths.join(paths.groupBy("o", "d").agg(F.min("path_id").alias("path_id")).select("path_id"), "path_id")
    rule = Generation(2, 0.5, "sequential", keep=2)
    folder = f"file:{tmp_path}/grown"
    one = ln.learn(few, links, od, THETA, [ln.Stage("s", 2)], folder, generation=rule)
    assert one.paths.table().count() > few.count()
    two = ln.learn(few, links, od, THETA, [ln.Stage("s", 2)], folder, generation=rule)
    assert {r["path_id"] for r in two.paths.table().collect()} == {r["path_id"] for r in one.paths.table().collect()}
    assert two.log == one.log


def test_links_no_iteration_moves_are_not_informative(yang, tmp_path):
    links, od, paths = yang
    folder = f"file:{tmp_path}/moved"
    done = ln.learn(paths, links, od, {"tt": -0.4, "c": 0.0}, [ln.Stage("s", 3, "ngd", 0.3)], folder)
    log = ln.link_log(links.sparkSession, folder)
    moved = {}
    for r in log.where("count is not null").collect():
        moved.setdefault((r["u"], r["v"]), []).append((r["iter"], r["err"]))
    want = {k for k, x in moved.items()
            if abs(max((b - a for (_, a), (_, b) in zip(sorted(x), sorted(x)[1:])), key=lambda s: s)) > 1e-10}
    kept = {(r["u"], r["v"]) for r in ln.only_informative(links, log).where("count is not null").collect()}
    assert kept == want and done.folder == folder


def _no_salts(*args, **kwargs):
    raise AssertionError("paths are moved for a small table")


def test_line_search_ends_move_no_paths_for_a_small_demand_table(yang, monkeypatch):
    links, od, paths = yang
    net = SimpleNamespace(links=links.withColumn("s", F.lit(0.1)), od=od, paths=paths.withColumn("trips", F.lit(2.0)))
    want = {r["path_id"]: r["f"] for r in ch.path_flows(ch.path_utility(paths, net.links, model.THETA), od).collect()}
    monkeypatch.setattr(ch, "salted_join", _no_salts)
    got = {r["path_id"]: r for r in model._two(net).collect()}
    assert set(got) == set(want) and all(r["f2"] == 2.0 and r["f1"] == pytest.approx(want[p], rel=1e-9) for p, r in got.items())


def test_batched_equilibria_move_no_paths_for_a_small_demand_table(yang, monkeypatch):
    links, od, paths = yang
    grid = sr.candidates([THETA], [1.0, 1.3])
    want = [es.loss(ch.equilibrium(paths, links, nw.scale_demand(od, s), t, iters=1, method="msa", accuracy=0.0).links).first()["sse"]
            for t, s in grid]
    monkeypatch.setattr(ch, "salted_join", _no_salts)
    got = sorted(sr.equilibria(paths, links, od, grid, iters=1, accuracy=0.0).collect(), key=lambda r: r["candidate"])
    assert [r["sse"] for r in got] == pytest.approx(want, rel=1e-9)
