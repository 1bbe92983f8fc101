"""Route choice, equilibrium and estimation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import choice as ch
from ..plans import estimation as es
from ..plans import learning as ln
from ..plans import searches as sr
from ..plans.generation import Generation
from ..session import pin
from .bindings import network, table, with_views
from .common import r, rounded
from .graph import _MADE, _PS, _SAMPLE, _cheap_walks
from .registry import query

C = F.col
THETA = {"tt": -0.15, "c": -0.5, "s": -0.2}
NAMES = list(THETA)

# SQL building blocks -------------------------------------------------------------------

_SUM = """
SELECT p.path_id, p.o, p.d, sum(l.tt) AS tt, sum(l.c) AS c, sum(l.s) AS s
FROM link_path p JOIN links l ON l.u = p.u AND l.v = p.v GROUP BY p.path_id, p.o, p.d"""


def util(theta: dict[str, float]) -> str:
    return " + ".join(f"({w!r}::DOUBLE * {k})" for k, w in theta.items())


def prob(v: str, source: str) -> str:
    """Probability p and flow f of the paths of ``source`` with utility ``v``."""
    return f"""
SELECT *, p * q AS f FROM (
  SELECT *, e / sum(e) OVER (PARTITION BY o, d) AS p FROM (
    SELECT t.*, od.q, exp(t.v - max(t.v) OVER (PARTITION BY t.o, t.d)) AS e
    FROM (SELECT *, {v} AS v FROM {source}) t JOIN od ON od.o = t.o AND od.d = t.d))"""


def spread(source: str, columns: dict[str, str]) -> str:
    """Sums of path columns over links; every link appears, unused ones with 0."""
    inner = ", ".join(f"sum({e}) AS {n}" for n, e in columns.items())
    outer = ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in columns)
    return f"""
SELECT l.*, {outer} FROM links l LEFT JOIN (
  SELECT k.u, k.v, {inner} FROM {source} z JOIN link_path k ON k.path_id = z.path_id
  GROUP BY k.u, k.v) h ON h.u = l.u AND h.v = l.v"""


PV = {"sums": _SUM}
PF = {**PV, "pf": prob(util(THETA), "sums")}
XF = {**PF, "xf": spread("pf", {"x": "f"})}


def sql(text: str, parts: dict[str, str] = XF) -> str:
    return with_views(text, "links", "od", **parts)


def _net(spark, sf):
    return network(spark, sf)


# choice --------------------------------------------------------------------------------

@query("C01_design_matrix", with_views("SELECT u, v, tt, c, s FROM links", "links"))
def c01(spark, sf):
    return ch.design_matrix(_net(spark, sf).links, NAMES).select("u", "v", *NAMES)


@query("C02_link_utility", with_views(f"SELECT u, v, {r(util(THETA), 'v_link')} FROM links", "links"))
def c02(spark, sf):
    return rounded(ch.link_utility(_net(spark, sf).links, THETA).select("u", "v", "v_link"))


@query("C13_best_parallel", with_views(
    f"SELECT o AS u, d AS v, {r('max(-0.1::DOUBLE * (l_orderkey % 97))', 'v_link')} FROM trip GROUP BY o, d",
    "trip"))
def c13(spark, sf):
    from ..operators.network import best_parallel
    links = _net(spark, sf).trip.select(C("o").alias("u"), C("d").alias("v"),
                                        (C("l_orderkey") % 97 * -0.1).alias("v_link"))
    return rounded(best_parallel(links))


@query("C03_path_utility", sql(
    f"SELECT path_id, {r(f'{util(THETA)} + 0.5::DOUBLE * ln(path_size)', 'v')} FROM sums JOIN ps USING (path_id)",
    {**PV, "ps": _PS}))
def c03(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.path_utility(net.paths, net.links, THETA, 0.5).select("path_id", "v"))


@query("C03_utility_parts", sql(
    f"SELECT path_id, {r(util({'tt': -0.15}), 'v_y')}, {r(util({'c': -0.5, 's': -0.2}), 'v_z')}, "
    f"{r('0.5::DOUBLE * ln(path_size)', 'v_path')} FROM sums JOIN ps USING (path_id)",
    {**PV, "ps": _PS}))
def c03_parts(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.utility_parts(net.paths, net.links, THETA, path_size=0.5).select(
        "path_id", "v_y", "v_z", "v_path"))


@query("W01_normalize", sql(
    f"SELECT path_id, {r('v - max(v) OVER (PARTITION BY o, d)', 'v_norm')} FROM pf", PF))
def w01(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.normalize(ch.path_utility(net.paths, net.links, THETA)).select(
        "path_id", "v_norm"))


@query("W02_softmax", sql(f"SELECT path_id, {r('p', 'p')} FROM pf", {
    "pf": prob("-0.3::DOUBLE * (trips - 2)", "path_trips")}))
def w02(spark, sf):
    paths = _net(spark, sf).paths.withColumn("v", -0.3 * (C("trips") - 2))
    return rounded(ch.probabilities(paths, {"p": "v"}).select("path_id", "p"))


@query("C04_probabilities", sql(f"SELECT path_id, o, d, {r('p', 'p')} FROM pf", PF))
def c04(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.choice(net.paths, net.links, THETA).select("path_id", "o", "d", "p"))


@query("C05_path_flows", sql(f"SELECT path_id, {r('f', 'f')} FROM pf", PF))
def c05(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.path_flows(ch.path_utility(net.paths, net.links, THETA), net.od).select(
        "path_id", "f"))


@query("C06_link_flows", sql(f"SELECT u, v, {r('x', 'x')} FROM xf"))
def c06(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.predict(net.paths, net.links, net.od, THETA).select("u", "v", "x"))


_BPRI = "tf * (x + alpha / (beta + 1) * pow(x / k, beta) * x)"


@query("C07_fisk_objective", sql(f"""
SELECT {r("a", "time_part", 3)}, {r("b", "exogenous_part", 3)}, {r("e", "entropy", 3)},
       {r("a + b - e", "objective", 3)} FROM (
  SELECT -0.15::DOUBLE * sum({_BPRI}) AS a, sum(({util({'c': -0.5, 's': -0.2})}) * x) AS b,
         (SELECT sum(f * ln(f + 1e-12)) FROM pf WHERE abs(f) >= 1e-12) AS e FROM xf)"""))
def c07(spark, sf):
    net = _net(spark, sf)
    pf = pin(ch.path_flows(ch.path_utility(net.paths, net.links, THETA), net.od))
    return rounded(ch.fisk_objective(net.paths, net.links, pf, THETA), 3)


_LAMS = [i / 10 for i in range(11)]
_ENDS = {**PF, "two": "SELECT pf.path_id, f AS f1, trips AS f2 FROM pf JOIN path_trips USING (path_id)",
         "ends": spread("two", {"e1": "f1", "e2": "f2"})}


def _along_sql(slope: bool, lams: list[float], digits: int) -> str:
    rows = []
    for i, lam in enumerate(lams):
        x = f"(e1 + {lam!r}::DOUBLE * (e2 - e1))"
        f = f"(f1 + {lam!r}::DOUBLE * (f2 - f1))"
        z = util({"c": -0.5, "s": -0.2})
        if slope:
            a = f"sum((-0.15::DOUBLE * (tf * (1 + alpha * pow({x} / k, beta))) + {z}) * (e2 - e1))"
            b = f"sum((CASE WHEN abs(f2 - f1) < 1e-12 THEN 0 ELSE f2 - f1 END) * (ln({f} + 1e-12) + 1))"
        else:
            a = f"sum(-0.15::DOUBLE * (tf * ({x} + alpha / (beta + 1) * pow({x} / k, beta) * {x})) + ({z}) * {x})"
            b = f"sum((CASE WHEN abs({f}) < 1e-12 THEN 0 ELSE {f} END) * ln({f} + 1e-12))"
        name = "slope" if slope else "objective"
        rows.append(f"SELECT {i} AS step, {lam!r}::DOUBLE AS lambda, "
                    + r(f"(SELECT {a} FROM ends) - (SELECT {b} FROM two)", name, digits))
    return sql(" UNION ALL ".join(rows), _ENDS)


def _two(net):
    # utilities are written once: the log-sums and the flows both read them
    v = pin(ch.path_utility(net.paths, net.links, THETA).select("path_id", "o", "d", "v"))
    pf = ch.path_flows(v, net.od, stored=True)
    pf = pf.join(net.paths.select("path_id", "trips"), "path_id")
    return pin(pf.select("path_id", "o", "d", C("f").alias("f1"), C("trips").alias("f2")))


@query("C08_fisk_slopes", _along_sql(True, [0.25, 0.5, 0.75], 3))
def c08(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.fisk_slopes(net.paths, net.links, _two(net), THETA, [0.25, 0.5, 0.75]), slope=3)


@query("C09_line_scan", _along_sql(False, _LAMS, 3))
def c09(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.fisk_scan(net.paths, net.links, _two(net), THETA, _LAMS), objective=3)


_STEPS = _along_sql(False, _LAMS, 9)


@query("C09_line_search_grid", f"""
WITH scan AS ({_STEPS})
SELECT "lambda" FROM scan WHERE step = (SELECT coalesce(min(step) - 1, 10) FROM (
  SELECT step, objective, lag(objective) OVER (ORDER BY step) AS prev FROM scan) WHERE objective <= prev)""")
def c09_grid(spark, sf):
    net = _net(spark, sf)
    step = ch.line_search(net.paths, net.links, _two(net), THETA, 11, "grid")
    return spark.createDataFrame([(float(step),)], "lambda double")


@query("C09_line_search_bisection")
def c09_bisection(spark, sf):
    net = _net(spark, sf)
    two = _two(net)
    step = float(ch.line_search(net.paths, net.links, two, THETA, 11, "bisection"))
    return ch.fisk_slopes(net.paths, net.links, two, THETA, [step]).select("lambda", "slope")


def _msa_parts(iters: int) -> dict[str, str]:
    """Assignment at free flow, then ``iters`` averaging steps, unrolled."""
    parts = dict(PV)
    parts["f0"] = f"SELECT path_id, o, d, c, s, f FROM ({prob(util(THETA), 'sums')})"
    for n in range(1, iters + 1):
        parts[f"x{n}"] = spread(f"f{n - 1}", {"x": "f"})
        parts[f"t{n}"] = f"""
SELECT k.path_id, sum(x.tf * (1 + x.alpha * pow(x.x / x.k, x.beta))) AS tt
FROM link_path k JOIN x{n} x ON x.u = k.u AND x.v = k.v GROUP BY k.path_id"""
        parts[f"s{n}"] = (f"SELECT f.path_id, f.o, f.d, t.tt, f.c, f.s, f.f AS prev "
                          f"FROM f{n - 1} f JOIN t{n} t USING (path_id)")
        parts[f"f{n}"] = (f"SELECT path_id, o, d, c, s, prev + (f - prev) / {n + 1} AS f "
                          f"FROM ({prob(util(THETA), f's{n}')})")
    parts["xf"] = spread(f"f{iters}", {"x": "f"})
    return parts


@query("C10_equilibrium_msa", sql(
    f"SELECT u, v, {r('x', 'x', 4)}, {r('tf * (1 + alpha * pow(x / k, beta))', 'tt', 4)} FROM xf",
    _msa_parts(2)))
def c10(spark, sf):
    net = _net(spark, sf)
    eq = ch.equilibrium(net.paths, net.links, net.od, THETA, iters=2, method="msa", accuracy=0.0)
    return rounded(eq.links.select("u", "v", "x", "tt"), 4)


_KEEP = 6
_FREE = {"tt": -1.0, "c": -1.0}
_GROWN = {
    "picked": _SAMPLE, **_cheap_walks(2, "picked", "tf + c"), "made": _MADE,
    "pool": """
SELECT path_id, o, d, 0 AS added FROM path_trips UNION ALL SELECT path_id, o, d, 1 FROM made m
WHERE rk <= 2 AND NOT EXISTS (SELECT 1 FROM path_trips p WHERE p.path_id = m.path_id)""",
    "pool_hop": """
SELECT path_id, o, d, CAST(parts[i] AS INTEGER) AS u, CAST(parts[i + 1] AS INTEGER) AS v
FROM (SELECT path_id, o, d, parts, unnest(range(1, len(parts))) AS i
      FROM (SELECT *, string_split(path_id, '/') AS parts FROM pool))""",
    "pool_sum": """
SELECT p.path_id, p.o, p.d, sum(l.tf) AS tt, sum(l.c) AS c FROM pool_hop p JOIN links l ON l.u = p.u AND l.v = p.v GROUP BY ALL""",
    "pool_p": f"SELECT path_id, o, d, tt, c, p FROM ({prob(util(_FREE), 'pool_sum')})",
    "stay": f"""
SELECT path_id, o, d, tt, c FROM (SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY round(p, 12) DESC, path_id) AS rk FROM pool_p)
WHERE rk <= {_KEEP}""",
    "stay_f": prob(util(_FREE), "stay"),
    "stay_x": "SELECT h.u, h.v, sum(z.f) AS x FROM stay_f z JOIN pool_hop h ON h.path_id = z.path_id GROUP BY h.u, h.v"}


@query("C10_column_generation", with_views(
    f"SELECT l.u, l.v, {r('coalesce(x, 0)', 'x')} FROM links l LEFT JOIN stay_x h ON h.u = l.u AND h.v = l.v",
    "links", "od", "path_trips", **_GROWN))
def c10_generation(spark, sf):
    net = _net(spark, sf)
    eq = ch.equilibrium(net.paths, net.links, net.od, _FREE, uncongested=True, generation=Generation(2, 0.3, keep=_KEEP))
    return rounded(eq.links.select("u", "v", "x"))


@query("C10_generation_counts", with_views("""
SELECT (SELECT count(*) FROM made WHERE rk <= 2) AS n_generated, (SELECT sum(added) FROM pool) AS n_added,
       (SELECT count(*) FROM pool) - (SELECT count(*) FROM stay) AS n_removed""", "links", "od", "path_trips", **_GROWN))
def c10_counts(spark, sf):
    net = _net(spark, sf)
    eq = ch.equilibrium(net.paths, net.links, net.od, _FREE, uncongested=True, generation=Generation(2, 0.3, keep=_KEEP))
    row = eq.log[0]
    return spark.createDataFrame([tuple(row[k] for k in ("n_generated", "n_added", "n_removed"))],
                                 "n_generated long, n_added long, n_removed long")


@query("C10_equilibrium_fw")
def c10_fw(spark, sf):
    net = _net(spark, sf)
    eq = ch.equilibrium(net.paths, net.links, net.od, THETA, iters=3, method="fw")
    return eq.links.select("u", "v", "x", "tt")


@query("V03_own_step_rule", sql(f"SELECT u, v, {r('x', 'x', 4)} FROM xf", {
    k: t.replace("/ 2 AS f", "* 0.25::DOUBLE AS f") for k, t in _msa_parts(1).items()}))
def v03(spark, sf):
    net = _net(spark, sf)
    eq = ch.equilibrium(net.paths, net.links, net.od, THETA, iters=1, accuracy=0.0,
                        method=lambda n, paths, links, both: 0.25)
    return rounded(eq.links.select("u", "v", "x"), 4)


@query("C11_exogenous_times", sql(f"SELECT u, v, {r('x', 'x')} FROM xf", {
    "sums": _SUM.replace("sum(l.tt) AS tt", "sum(l.tf * 1.2::DOUBLE + l.s) AS tt"),
    "pf": prob(util(THETA), "sums"), "xf": spread("pf", {"x": "f"})}))
def c11(spark, sf):
    net = _net(spark, sf)
    links = net.links.withColumn("given", C("tf") * 1.2 + C("s"))
    eq = ch.equilibrium(net.paths, links, net.od, THETA, exogenous_times="given")
    return rounded(eq.links.select("u", "v", "x"))


@query("C11_uncongested", sql(f"SELECT u, v, {r('x', 'x')} FROM xf"))
def c11_free(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.equilibrium(net.paths, net.links, net.od, THETA, uncongested=True).links.select(
        "u", "v", "x"))


_EQ = {"pf": "SELECT path_id, od.q / count(*) OVER (PARTITION BY od.o, od.d) AS f "
             "FROM path_trips t JOIN od ON od.o = t.o AND od.d = t.d",
       "xf": spread("pf", {"x": "f"})}


@query("C12_equal_choice", sql(f"SELECT u, v, {r('x', 'x')} FROM xf", _EQ))
def c12(spark, sf):
    net = _net(spark, sf)
    return rounded(ch.equal_choice(net.paths, net.links, net.od).select("u", "v", "x"))


_LOSS = (f"SELECT count(count) AS n, {r('sum(pow(x - count, 2))', 'sse', 2)} FROM xf "
         "WHERE count IS NOT NULL")


@query("C12_equal_choice_loss", sql(_LOSS, _EQ))
def c12_loss(spark, sf):
    net = _net(spark, sf)
    return rounded(es.loss_equal_choice(net.paths, net.links, net.od), 2)


@query("C14_congested_loss", sql(_LOSS, _msa_parts(1)))
def c14(spark, sf):
    net = _net(spark, sf)
    return rounded(es.loss_congested(net.paths, net.links, net.od, THETA, iters=1, method="msa",
                                     accuracy=0.0), 2)


# estimation ----------------------------------------------------------------------------

def resp_parts(theta: dict[str, float], second: bool = False) -> dict[str, str]:
    """Links with x, j_k (and h_k) at ``theta``."""
    names = list(theta)
    parts = dict(PV)
    parts["pf"] = prob(util(theta), "sums")
    means = ", ".join(f"sum(p * {k}) OVER (PARTITION BY o, d) AS m_{k}" for k in names)
    parts["pm"] = f"SELECT *, {means} FROM pf"
    cols = {"x": "f", **{f"j_{k}": f"f * ({k} - m_{k})".replace(f"({k} ", f"(z.{k} ") for k in names}}
    if second:
        var = ", ".join(f"sum(p * pow({k} - m_{k}, 2)) OVER (PARTITION BY o, d) AS w_{k}" for k in names)
        parts["pw"] = f"SELECT *, {var} FROM pm"
        cols |= {f"h_{k}": f"f * (pow(z.{k} - m_{k}, 2) - w_{k})" for k in names}
    parts["rs"] = spread("pw" if second else "pm", cols)
    return parts


RS, RS2 = resp_parts(THETA), resp_parts(THETA, True)
_E = "(x - count)"


def _resp(spark, sf, second: bool = False, theta=THETA):
    net = _net(spark, sf)
    return es.response(net.paths, net.links, net.od, theta, second)


@query("E01_errors", sql(
    f"SELECT u, v, {r(f'coalesce({_E}, 0)', 'err')}, {r(f'coalesce({_E} * {_E}, 0)', 'sq_err', 4)} FROM xf"))
def e01(spark, sf):
    net = _net(spark, sf)
    out = es.errors(ch.predict(net.paths, net.links, net.od, THETA))
    return rounded(out.select("u", "v", "err", "sq_err"), sq_err=4)


@query("E01_loss", sql(_LOSS))
def e01_loss(spark, sf):
    net = _net(spark, sf)
    return rounded(es.loss(ch.predict(net.paths, net.links, net.od, THETA)), 2)


@query("E02_gradient", sql("SELECT " + ", ".join(
    r(f"2 * sum(j_{k} * {_E})", f"g_{k}", 2) for k in NAMES) + " FROM rs", RS))
def e02(spark, sf):
    return rounded(es.gradient(_resp(spark, sf), NAMES), 2)


@query("E03_jacobian", sql(" UNION ALL ".join(
    f"SELECT u, v, '{k}' AS feature, {r(f'j_{k}', 'jacobian', 5)} FROM rs" for k in NAMES), RS))
def e03(spark, sf):
    return rounded(es.jacobian(_resp(spark, sf), NAMES).select("u", "v", "feature", "jacobian"), 5)


@query("E04_diagonal_hessian", sql("SELECT " + ", ".join(
    r(f"2 * sum(j_{k} * j_{k} + h_{k} * {_E})", f"h_{k}", 2) for k in NAMES)
    + " FROM rs WHERE count IS NOT NULL", RS2))
def e04(spark, sf):
    return rounded(es.diagonal_hessian(_resp(spark, sf, True), NAMES), 2)


_NS = ", ".join(["count(count) AS n", r(f"sum({_E} * {_E})", "sse", 2)]
                + [r(f"sum(j_{a} * {_E})", f"jr_{a}", 2) for a in NAMES]
                + [r(f"sum(j_{a} * j_{b})", f"jj_{a}_{b}", 2)
                   for i, a in enumerate(NAMES) for b in NAMES[i:]])


@query("E05_normal_sums", sql(f"SELECT {_NS} FROM rs WHERE count IS NOT NULL", RS))
def e05(spark, sf):
    return rounded(es.normal_sums(_resp(spark, sf), NAMES), 2)


def _theta_rows(spark, rows):
    return spark.createDataFrame(rows, "method string, parameter string, est double")


@query("E06_gradient_step", sql(" UNION ALL ".join(
    f"SELECT 'gd' AS method, '{k}' AS parameter, "
    + r(f"{THETA[k]!r}::DOUBLE - 1e-9::DOUBLE * 2 * sum(j_{k} * {_E})", "est", 7) + " FROM rs"
    for k in NAMES), RS))
def e06_gd(spark, sf):
    net = _net(spark, sf)
    _, steps = es.step_candidates(net.paths, net.links, net.od, THETA, "gd", 1e-9)
    return rounded(_theta_rows(spark, [("gd", k, t) for k, t in steps[0].items()]), 7)


@query("E06_update_methods")
def e06(spark, sf):
    net = _net(spark, sf)
    rows = []
    for method in ("ngd", "newton", "gauss-newton", "lm"):
        _, steps = es.step_candidates(net.paths, net.links, net.od, THETA, method, 0.1, [0.01],
                                      fixed=["s"])
        rows += [(method, k, t) for k, t in steps[0].items()]
    return _theta_rows(spark, rows)


@query("V02_own_update_rule", sql(" UNION ALL ".join(
    f"SELECT 'own' AS method, '{k}' AS parameter, "
    + r(f"{THETA[k]!r}::DOUBLE - 0.01::DOUBLE * sign(sum(j_{k} * {_E}))", "est", 7) + " FROM rs"
    for k in NAMES), RS))
def v02(spark, sf):
    import numpy as np
    net = _net(spark, sf)
    rule = lambda jj, jr, hr, eta, lam: -0.01 * np.sign(jr)
    _, steps = es.step_candidates(net.paths, net.links, net.od, THETA, rule)
    return rounded(_theta_rows(spark, [("own", k, t) for k, t in steps[0].items()]), 7)


def _solved(damping: str) -> dict[str, str]:
    """SQL of the solution x of (J'J + damping * diag J'J) x = J'r and of the diagonal of the
    inverse, for three weights, by cofactors of ``ns``."""
    def cell(a: str, b: str) -> str:
        i, j = sorted((NAMES.index(a), NAMES.index(b)))
        name = f"jj_{NAMES[i]}_{NAMES[j]}"
        return f"({name} * (1 + {damping}))" if a == b else name
    a, b, c = NAMES
    minor = {(a, a): f"({cell(b, b)} * {cell(c, c)} - {cell(b, c)} * {cell(b, c)})",
             (a, b): f"({cell(a, c)} * {cell(b, c)} - {cell(a, b)} * {cell(c, c)})",
             (a, c): f"({cell(a, b)} * {cell(b, c)} - {cell(a, c)} * {cell(b, b)})",
             (b, b): f"({cell(a, a)} * {cell(c, c)} - {cell(a, c)} * {cell(a, c)})",
             (b, c): f"({cell(a, b)} * {cell(a, c)} - {cell(a, a)} * {cell(b, c)})",
             (c, c): f"({cell(a, a)} * {cell(b, b)} - {cell(a, b)} * {cell(a, b)})"}
    det = f"({cell(a, a)} * {minor[a, a]} + {cell(a, b)} * {minor[a, b]} + {cell(a, c)} * {minor[a, c]})"
    at = lambda x, y: minor[min(x, y, key=NAMES.index), max(x, y, key=NAMES.index)]
    return {**{f"x_{k}": "(" + " + ".join(f"{at(k, o)} * jr_{o}" for o in NAMES) + f") / {det}" for k in NAMES},
            **{f"inv_{k}": f"{at(k, k)} / {det}" for k in NAMES}}


_RAW_NS = ", ".join(["count(count) AS n", f"sum({_E} * {_E}) AS sse"]
                    + [f"sum(j_{a} * {_E}) AS jr_{a}" for a in NAMES]
                    + [f"sum(j_{a} * j_{b}) AS jj_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[i:]])
_NORMAL = {**RS, "ns": f"SELECT {_RAW_NS} FROM rs WHERE count IS NOT NULL"}
_AT_ROW = " + ".join(f"th_{k} * {k}" for k in NAMES)


def _moved(name: str, theta: dict[str, str]) -> dict[str, str]:
    """Parts: weights by SQL text, then the loss at them."""
    return {f"th{name}": "SELECT " + ", ".join(f"{t} AS th_{k}" for k, t in theta.items()) + " FROM ns",
            f"pf{name}": prob(_AT_ROW, f"(SELECT s.*, w.* FROM sums s, th{name} w)"),
            f"xf{name}": spread(f"pf{name}", {"x": "f"}),
            f"ls{name}": f"SELECT sum({_E} * {_E}) AS sse FROM xf{name} WHERE count IS NOT NULL"}


_TRIES = [1e-2, 5e-3, 3e-2]
_LM = dict(_NORMAL)
for _i, _lam in enumerate(_TRIES):
    _x = _solved(f"{_lam!r}::DOUBLE")
    _LM |= _moved(str(_i), {k: f"{THETA[k]!r}::DOUBLE - {_x[f'x_{k}']}" for k in NAMES})
_LM["tried"] = " UNION ALL ".join(
    f"SELECT {i} AS i, {lam!r}::DOUBLE AS damping, l.sse, w.* FROM ls{i} l, th{i} w" for i, lam in enumerate(_TRIES))
_LM["top"] = "SELECT * FROM tried ORDER BY sse, i LIMIT 1"


@query("E07_damped_step", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS parameter, {r(f'CASE WHEN t.sse < n.sse THEN th_{k} ELSE {THETA[k]!r}::DOUBLE END', 'est', 5)}, "
    f"CASE WHEN t.sse < n.sse THEN damping ELSE 0.03::DOUBLE END AS damping, {r('least(t.sse, n.sse)', 'sse', 1)} "
    f"FROM top t, ns n" for k in NAMES), _LM))
def e07(spark, sf):
    net = _net(spark, sf)
    theta, lam, sse = es.damped_step(net.paths, net.links, net.od, THETA)
    out = spark.createDataFrame([(k, t, lam, sse) for k, t in theta.items()],
                                "parameter string, est double, damping double, sse double")
    return rounded(out, 5, damping=-1, sse=1)


_SIGNED = """
SELECT l_returnflag || l_linestatus || l_linenumber AS parameter,
       CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS sign,
       avg(l_discount) - CAST(0.05 AS DOUBLE) AS est FROM lineitem
GROUP BY l_returnflag, l_linestatus, l_linenumber"""


@query("E08_project_signs", with_views(f"""
SELECT parameter, {r("CASE sign WHEN '+' THEN greatest(est, 0) WHEN '-' THEN least(est, 0) ELSE est END", "est")}
FROM p""", p=_SIGNED))
def e08(spark, sf):
    li = table(spark, sf, "lineitem")
    params = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        (F.avg("l_discount") - 0.05).alias("est"))
    params = params.select(
        F.concat("l_returnflag", "l_linestatus", C("l_linenumber").cast("string")).alias("parameter"),
        F.when(C("l_linenumber") % 3 == 0, "+").when(C("l_linenumber") % 3 == 1, "-").alias("sign"),
        "est")
    return rounded(es.project_signs(params).select("parameter", "est"))


_START = {"tt": 0.0, "c": 0.0, "s": 0.0}


@query("E09_estimate")
def e09(spark, sf):
    net = _net(spark, sf)
    fit = es.estimate(net.paths, net.links, net.od, _START, iters=3, method="lm",
                      signs={"tt": "-", "c": "-", "s": "-"})
    rows = [(r_["stage"], r_["iter"], r_["objective"], r_["theta_tt"], r_["theta_c"], r_["theta_s"])
            for r_ in fit.log]
    return spark.createDataFrame(rows, "stage string, iter int, objective double, "
                                       "theta_tt double, theta_c double, theta_s double")


@query("E10_adjust_demand", sql(f"""
SELECT od.o, od.d, {r("greatest(0, od.q - 0.01::DOUBLE * (200 * (od.q - od.q * 0.9::DOUBLE) + 2 * coalesce(g.g, 0)) / (SELECT count(*) FROM links))", "q")}
FROM od LEFT JOIN (
  SELECT z.o, z.d, sum(z.p * coalesce(x.x - x.count, 0)) AS g FROM pf z
  JOIN link_path k ON k.path_id = z.path_id JOIN xf x ON x.u = k.u AND x.v = k.v
  GROUP BY z.o, z.d) g ON g.o = od.o AND g.d = od.d"""))
def e10(spark, sf):
    net = _net(spark, sf)
    pf = pin(ch.path_flows(ch.path_utility(net.paths, net.links, THETA), net.od))
    prior = net.od.withColumn("q", C("q") * 0.9)
    return rounded(es.adjust_demand(net.paths, pf, ch.link_flows(net.paths, net.links, pf), net.od, prior, step=0.01))


_DET = ("(jj_tt_tt * (jj_c_c * jj_s_s - jj_c_s * jj_c_s) - jj_tt_c * (jj_tt_c * jj_s_s - jj_c_s * jj_tt_s)"
        " + jj_tt_s * (jj_tt_c * jj_c_s - jj_c_c * jj_tt_s))")
_COF = {"tt": "(jj_c_c * jj_s_s - jj_c_s * jj_c_s)", "c": "(jj_tt_tt * jj_s_s - jj_tt_s * jj_tt_s)",
        "s": "(jj_tt_tt * jj_c_c - jj_tt_c * jj_tt_c)"}
_RAW = ", ".join(["count(count) AS n", f"sum({_E} * {_E}) AS sse"] + [
    f"sum(j_{a} * j_{b}) AS jj_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[i:]])


@query("E11_t_values", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS parameter, {THETA[k]!r}::DOUBLE AS est, "
    + r(f"{THETA[k]!r}::DOUBLE / sqrt(sse / (n - 3) * {_COF[k]} / {_DET})", "t_test", 5)
    + " FROM ns" for k in NAMES), {**RS, "ns": f"SELECT {_RAW} FROM rs WHERE count IS NOT NULL"}))
def e11_values(spark, sf):
    tests = es.t_tests(pin(_resp(spark, sf)), THETA)
    return rounded(tests.select("parameter", "est", "t_test"), 5, est=-1)


@query("E11_t_tests")
def e11(spark, sf):
    return es.t_tests(pin(_resp(spark, sf)), THETA)


@query("E11_t_tests_lowest_sse")
def e11_low(spark, sf):
    return es.t_tests(pin(_resp(spark, sf)), THETA, percent=90.0)


@query("E12_f_test", sql(f"""
SELECT 0 AS dof_m1, 3 AS dof_m2, {r("s1", "sse_m1", 2)}, {r("s2", "sse_m2", 2)}, n,
       {r("((s1 - s2) / 3) / (s2 / (n - 3))", "F", 4)}
FROM (SELECT count(count) AS n, sum(pow(x - count, 2)) AS s2 FROM xf),
     (SELECT sum(pow(x - count, 2)) AS s1 FROM xe)""", {
    **XF, "ef": _EQ["pf"], "xe": spread("ef", {"x": "f"})}))
def e12(spark, sf):
    net = _net(spark, sf)
    full = ch.predict(net.paths, net.links, net.od, THETA)
    none = ch.predict(net.paths, net.links, net.od, {k: 0.0 for k in THETA})
    return rounded(es.f_test(full, none, 3), 2, F=4)


_STEP2 = {**_NORMAL, **_moved("1", {k: f"{THETA[k]!r}::DOUBLE - 1e-9::DOUBLE * 2 * jr_{k}" for k in NAMES})}


@query("E09_two_iterations", sql(
    f"SELECT 1 AS iter, {r('sse', 'objective', 1)}, " + ", ".join(f"{THETA[k]!r}::DOUBLE AS theta_{k}" for k in NAMES)
    + f" FROM ns UNION ALL SELECT 2, {r('l.sse', 'objective', 1)}, " + ", ".join(r(f"th_{k}", f"theta_{k}", 7) for k in NAMES)
    + " FROM ls1 l, th1", _STEP2))
def e09_steps(spark, sf):
    net = _net(spark, sf)
    done = ln.learn(net.paths, net.links, net.od, THETA, [ln.Stage("first", 2, "gd", 1e-9)])
    theta = F.from_json("theta", "map<string,double>")
    rows = ln.iterations(spark, done.folder).select("iter", "objective", *[theta[k].alias(f"theta_{k}") for k in NAMES])
    return rounded(rows, 7, objective=1)


_INV = _solved("0")


@query("E13_t_values", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS parameter, {THETA[k]!r}::DOUBLE AS est, "
    + r(f"{THETA[k]!r}::DOUBLE / sqrt({_INV[f'inv_{k}']} * sse / (n - 3))", "t_test", 4) + " FROM ns" for k in NAMES), _NORMAL))
def e13_t(spark, sf):
    net = _net(spark, sf)
    _, tests, _ = es.infer(net.paths, net.links, net.od, THETA, iters=1)
    return rounded(tests.select("parameter", "est", "t_test"), 4, est=-1)


_P11 = """
SELECT u, v FROM (SELECT a.u, a.v, (b.x - b.count) - (a.x - a.count) AS moved FROM xf a JOIN xf1 b ON a.u = b.u AND a.v = b.v
  WHERE a.count IS NOT NULL) WHERE NOT abs(moved) <= 1e-6"""


@query("P11_informative_of_iterations", sql(_P11.replace("FROM xf a", "FROM rs a"), _STEP2))
def p11_iterations(spark, sf):
    from ..operators.filters import informative_links
    net = _net(spark, sf)
    done = ln.learn(net.paths, net.links, net.od, THETA, [ln.Stage("first", 2, "gd", 1e-9)])
    log = ln.link_log(spark, done.folder).where(C("count").isNotNull())
    return informative_links(log, ["u", "v"], 1e-6).select("u", "v")


@query("E13_inference")
def e13(spark, sf):
    net = _net(spark, sf)
    _, tests, model = es.infer(net.paths, net.links, net.od, _START, iters=2, method="lm")
    for name in ("F", "p", "critical-F", "sse_m1", "sse_m2"):
        tests = tests.withColumn(name, F.lit(float(model[name])))
    return tests


_GRID = [-1.0, -0.5, -0.15, 0.0, 0.5]


def _grid_parts() -> dict[str, str]:
    """One response per grid value, all in one statement, with its own names."""
    parts = dict(PV)
    for i, t in enumerate(_GRID):
        own = resp_parts({**THETA, "tt": t}, True)
        for name in ("pf", "pm", "pw", "rs"):
            text = own[name]
            for dep in ("pf", "pm", "pw"):
                text = text.replace(f"FROM {dep} ", f"FROM {dep}{i} ").replace(
                    f"FROM {dep}\n", f"FROM {dep}{i}\n")
                if text.endswith(f"FROM {dep}"):
                    text += str(i)
            parts[f"{name}{i}"] = text
    return parts


@query("E14_grid_scan", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, {t!r}::DOUBLE AS theta, {r(f'sum({_E} * {_E})', 'sse', 2)}, "
    f"{r(f'2 * sum(j_tt * {_E})', 'gradient', 2)}, {r(f'2 * sum(j_tt * j_tt + h_tt * {_E})', 'hessian', 2)} "
    f"FROM rs{i} WHERE count IS NOT NULL" for i, t in enumerate(_GRID)), _grid_parts()))
def e14(spark, sf):
    net = _net(spark, sf)
    out = es.grid_scan(net.paths, net.links, net.od, THETA, "tt", _GRID)
    return rounded(out.select("candidate", "theta", "sse", "gradient", "hessian"), 2, theta=-1)


@query("E15_grid_t_values", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, {t!r}::DOUBLE AS theta, "
    + r(f"{t!r}::DOUBLE / sqrt(sum({_E} * {_E}) / (count(*) - 1) / sum(j_tt * j_tt))", "t_test", 4)
    + f" FROM rs{i} WHERE count IS NOT NULL" for i, t in enumerate(_GRID)), _grid_parts()))
def e15(spark, sf):
    net = _net(spark, sf)
    scan = es.grid_scan(net.paths, net.links, net.od, THETA, "tt", _GRID)
    return rounded(es.grid_t_values(scan), 4, theta=-1)


_POINTS = [({**THETA, "tt": t}, s) for t, s in ((-0.3, 1.0), (-0.15, 1.0), (-0.05, 0.9), (-0.15, 1.2), (-0.1, 1.0))]


def _normal_at(grid) -> dict[str, str]:
    """``rs`` and ``ns`` for each candidate of weights and demand scale."""
    parts = dict(PV)
    for i, (theta, scale) in enumerate(grid):
        parts[f"pf{i}"] = f"SELECT * REPLACE (f * {scale!r}::DOUBLE AS f) FROM ({prob(util(theta), 'sums')})"
        parts[f"mean{i}"] = "SELECT o, d, " + ", ".join(f"sum(p * {k}) AS m_{k}" for k in NAMES) + f" FROM pf{i} GROUP BY o, d"
        parts[f"dv{i}"] = (f"SELECT p.path_id, p.f, " + ", ".join(f"p.f * (p.{k} - m.m_{k}) AS j_{k}" for k in NAMES)
                           + f" FROM pf{i} p JOIN mean{i} m ON m.o = p.o AND m.d = p.d")
        parts[f"rs{i}"] = spread(f"dv{i}", {"x": "f", **{f"j_{k}": f"j_{k}" for k in NAMES}})
        parts[f"ns{i}"] = f"SELECT {_RAW_NS} FROM rs{i} WHERE count IS NOT NULL"
    return parts


@query("E15_t_values_of_all", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, {s!r}::DOUBLE AS scale, '{k}' AS parameter, {t[k]!r}::DOUBLE AS theta, "
    + r(f"{t[k]!r}::DOUBLE / sqrt({_INV[f'inv_{k}']} * sse / (n - 3))", "t_test", 4) + f" FROM ns{i}"
    for i, (t, s) in enumerate(_POINTS) for k in NAMES), _normal_at(_POINTS)))
def e15_all(spark, sf):
    net = _net(spark, sf)
    out = sr.t_grid(net.paths, net.links, net.od, _POINTS)
    return rounded(out.select("candidate", "scale", "parameter", "theta", "t_test"), 4, theta=-1, scale=-1)


_CONGESTED = [({**THETA, "tt": t}, s) for t in (-0.3, -0.15) for s in (1.0, 1.1)]


def _congested_parts(grid, iters: int) -> dict[str, str]:
    """The unrolled iterations of ``_msa_parts`` for each candidate."""
    parts = dict(PV)
    for i, (theta, scale) in enumerate(grid):
        flow = lambda source: f"SELECT path_id, o, d, c, s, f * {scale!r}::DOUBLE AS f FROM ({prob(util(theta), source)})"  # noqa: B023, E731
        parts[f"f{i}_0"] = flow("sums").replace("SELECT path_id", "SELECT path_id", 1)
        for n in range(1, iters + 1):
            parts[f"x{i}_{n}"] = spread(f"f{i}_{n - 1}", {"x": "f"})
            parts[f"t{i}_{n}"] = f"""
SELECT k.path_id, sum(x.tf * (1 + x.alpha * pow(x.x / x.k, x.beta))) AS tt
FROM link_path k JOIN x{i}_{n} x ON x.u = k.u AND x.v = k.v GROUP BY k.path_id"""
            parts[f"s{i}_{n}"] = (f"SELECT f.path_id, f.o, f.d, t.tt, f.c, f.s, f.f AS prev FROM f{i}_{n - 1} f JOIN t{i}_{n} t USING (path_id)")
            parts[f"f{i}_{n}"] = (f"SELECT path_id, o, d, c, s, prev + (f * {scale!r}::DOUBLE - prev) / {n + 1} AS f "
                                  f"FROM ({prob(util(theta), f's{i}_{n}')})")
        parts[f"xf{i}"] = spread(f"f{i}_{iters}", {"x": "f"})
    return parts


@query("E16_congested_search", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, {s!r}::DOUBLE AS scale, count(*) AS n, {r('sum(pow(x - count, 2))', 'sse', 1)} "
    f"FROM xf{i} WHERE count IS NOT NULL" for i, (_, s) in enumerate(_CONGESTED)), _congested_parts(_CONGESTED, 2)))
def e16_congested(spark, sf):
    net = _net(spark, sf)
    out = sr.equilibria(net.paths, net.links, net.od, _CONGESTED, iters=2, accuracy=0.0)
    return rounded(out.select("candidate", "scale", "n", "sse"), 1, scale=-1)


@query("T06_best_grid_point", sql(
    "SELECT theta, sse FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS candidate, {t!r}::DOUBLE AS theta, {r(f'sum({_E} * {_E})', 'sse', 2)} "
        f"FROM rs{i} WHERE count IS NOT NULL" for i, t in enumerate(_GRID))
    + ") ORDER BY sse, candidate LIMIT 1", _grid_parts()))
def t06(spark, sf):
    net = _net(spark, sf)
    scan = es.grid_scan(net.paths, net.links, net.od, THETA, "tt", _GRID)
    return rounded(es.best_candidate(scan), 2, theta=-1)


def _flow_parts(grid: list[dict[str, float]]) -> dict[str, str]:
    parts = dict(PV)
    for i, theta in enumerate(grid):
        parts[f"pf{i}"] = prob(util(theta), "sums")
        parts[f"xf{i}"] = spread(f"pf{i}", {"x": "f"})
    return parts


_CANDS = [{**THETA, "tt": t} for t in _GRID]


@query("J14_grid_flows", sql(" UNION ALL ".join(
    f"SELECT u, v, {i} AS candidate, {r('x', 'x')} FROM xf{i}" for i in range(len(_GRID))),
    _flow_parts(_CANDS)))
def j14(spark, sf):
    net = _net(spark, sf)
    return rounded(es.flows_long(net.paths, net.links, net.od, _CANDS).select(
        "u", "v", "candidate", "x"))


@query("R09_monotonicity", sql("SELECT x0.u, x0.v, " + ", ".join(
    r(f"x{i}.x", f"t{i}") for i in range(len(_GRID))) + " FROM xf0 x0 " + " ".join(
    f"JOIN xf{i} x{i} ON x{i}.u = x0.u AND x{i}.v = x0.v" for i in range(1, len(_GRID))),
    _flow_parts(_CANDS)))
def r09(spark, sf):
    from ..operators.reshape import monotonicity
    net = _net(spark, sf)
    long = es.flows_long(net.paths, net.links, net.od, _CANDS)
    theta = F.element_at(F.array(*[F.lit(t) for t in _GRID]), C("candidate") + 1)
    return rounded(monotonicity(long.withColumn("theta", theta), _GRID))


_DRAWS = es.random_grid({"tt": (-1, 0), "c": (-1, 0), "s": (-1, 0)}, 8, 5)


@query("E16_random_search", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, count(count) AS n, {r('sum(pow(x - count, 2))', 'sse', 2)} "
    f"FROM xf{i} WHERE count IS NOT NULL" for i in range(len(_DRAWS))), _flow_parts(_DRAWS)))
def e16(spark, sf):
    net = _net(spark, sf)
    return rounded(es.losses_at(net.paths, net.links, net.od, _DRAWS), 2)


@query("E17_demand_scale", sql(" UNION ALL ".join(
    f"SELECT {f!r}::DOUBLE AS factor, {r(f'sum(pow({f!r}::DOUBLE * x - count, 2))', 'sse', 2)} "
    "FROM xf WHERE count IS NOT NULL" for f in (0.5, 0.9, 1.0, 1.1, 2.0))))
def e17(spark, sf):
    net = _net(spark, sf)
    at = ch.predict(net.paths, net.links, net.od, THETA)
    return rounded(es.demand_scale_losses(at, [0.5, 0.9, 1.0, 1.1, 2.0]), 2, factor=-1)


_LASSO = [0.0, 0.18, 0.3, 0.6]
_SHRUNK = [{k: (abs(t) - lam > 0) * (1 if t > 0 else -1) * (abs(t) - lam) + 0.0
            for k, t in THETA.items()} for lam in _LASSO]


@query("E18_lasso_path", sql(" UNION ALL ".join(
    f"SELECT {i} AS candidate, count(count) AS n, {r('sum(pow(x - count, 2))', 'sse', 2)} "
    f"FROM xf{i} WHERE count IS NOT NULL" for i in range(len(_LASSO))), _flow_parts(_SHRUNK)))
def e18(spark, sf):
    net = _net(spark, sf)
    return rounded(es.lasso_path(net.paths, net.links, net.od, THETA, _LASSO), 2)


# two steps of 0.1 from 1 pass 1, and 0.9 or 1.1
_MULTIPLIERS = [0.9, 1.0, 1.1]
_SLOPES = _normal_at([({k: m * t for k, t in THETA.items()}, 1.0) for m in _MULTIPLIERS])
_SIGN = {m: "sign(" + " + ".join(f"{THETA[k]!r}::DOUBLE * g{i}.jr_{k}" for k in NAMES) + ")"
         for i, m in enumerate(_MULTIPLIERS)}
_ONE = f"(1 - 0.1::DOUBLE * {_SIGN[1.0]})"


@query("E19_scale_stage", sql(
    f"SELECT 1 AS iter, {r(_ONE, 'multiplier')} FROM ns1 g1 UNION ALL SELECT 2, "
    + r(f"{_ONE} - 0.1::DOUBLE * CASE WHEN {_ONE} < 1 THEN {_SIGN[0.9]} ELSE {_SIGN[1.1]} END", "multiplier")
    + " FROM ns0 g0, ns1 g1, ns2 g2", _SLOPES))
def e19(spark, sf):
    net = _net(spark, sf)
    _, trail = es.scale_stage(net.paths, net.links, net.od, THETA, 2)
    return rounded(spark.createDataFrame([(i + 1, float(m)) for i, m in enumerate(trail)], "iter int, multiplier double"))


@query("E21_initial_values", with_views(f"""
SELECT parameter, sign, CASE WHEN est > 0 THEN est + 0 ELSE 0 END AS init FROM (
  SELECT parameter, sign, {r("est", "est")} FROM p)
UNION ALL SELECT 'rain', '-', 0""", p=_SIGNED))
def e21(spark, sf):
    li = table(spark, sf, "lineitem")
    params = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        (F.avg("l_discount") - 0.05).alias("est"))
    est = F.round(C("est") + F.lit(3.7e-10), 6)
    params = params.select(
        F.concat("l_returnflag", "l_linestatus", C("l_linenumber").cast("string")).alias("parameter"),
        F.when(C("l_linenumber") % 3 == 0, "+").when(C("l_linenumber") % 3 == 1, "-").alias("sign"),
        F.lit(0).alias("fixed"), F.when(est > 0, est).alias("init"),
        F.lit(None).cast("double").alias("true"))
    out = es.initial_values(es.add_features(params, ["rain"], "-", 0.0))
    return out.select("parameter", "sign", "init")

