from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgrain.llm.common import table
from flowgrain.llm.queries_models import op12
from flowgrain.llm.whitening import LIMIT, eigenvectors, products, whiten

from .cases import SMALL, folder

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows):
    """(n, deviations by id, whitened by id, explained) from exact fractions and plain numpy."""
    kept = [(i, [floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(d)] for x in fit]
    v = np.array([[float(sum(y[i] * y[j] for y in centred) / n) for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), y @ axes[:, :16] / np.sqrt(e[:16])))
    return n, out, e[:16] / np.trace(v)


def compare(got, rows, close=1e-7):
    n, want, explained = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want)
    signs = None
    for i, found in by.items():
        k = len(explained)
        assert len(found) == k * len(want[i])
        for r in found[:k]:
            assert r.n == n and r.deviation == want[i][0][0] and r.identity_error < 1e-9
            assert abs(r.explained - explained[r.component - 1]) < 1e-9
        z = np.array([r.whitened for r in sorted(found, key=lambda r: r.component)[::len(want[i])]])
        now = np.sign(z * want[i][0][1])
        signs = now if signs is None else signs
        assert np.allclose(z, signs * want[i][0][1], atol=close)


def test_query_against_fractions(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    compare(op12(spark, SMALL).collect(), rows)


def test_awkward_rows(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.normal(0, [4, 2, 1], 3)]) for i in range(60)]
    rows += [rows[5]] * 40 + [(None, rows[7][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]),
           (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows + bad], SCHEMA)
    got = op12(spark, folder(tmp_path, spark, embeddings=frame)).collect()
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    compare(got, rows)
    assert len({r.identity_error for r in got}) == 1 and got[0].n == 60


def test_no_rows_one_row_and_flat_dimensions(spark):
    empty = spark.createDataFrame([(1, None, 1, "c")], SCHEMA)
    assert whiten(empty).collect() == [] and whiten(empty.where("vec_id > 1")).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0], 1, "c")] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (1, 0, None, 0.0, None)}
    flat = spark.createDataFrame([(i, [float(i), 7.0, float(2 * i)], 1, "c") for i in range(20)], SCHEMA)
    got = whiten(flat).collect()
    assert {r.component for r in got if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-12 for r in got)


def test_deviation_beyond_64_bits_is_null(spark):
    big = float(LIMIT // 64 // 2)
    frame = spark.createDataFrame([(0, [big]), (1, [-big]), (2, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whiten(frame).collect()}
    assert got[0] is None and got[1] is None and got[2] == (3 * 10**6 - 3 * 10**6) ** 2


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 44), st.integers(1, 300), st.integers(0, 2**31))
def test_products_are_exact(bits, rows, seed):
    x = np.random.default_rng(seed).integers(-(1 << bits), (1 << bits) + 1, (rows, 3))
    want = x.astype(object).T @ x.astype(object)
    assert (products(x) == want).all()


@pytest.mark.parametrize("values", [
    list(np.linspace(1, 10, 40)), [10, 9, 1, 1 + 1e-9, 1 + 2e-9, *np.linspace(2, 3, 20)],
    [1, 1 + 1e-6, 1 + 3e-6, 5, 5 + 1e-7], list(np.logspace(-9, 0, 20))])
def test_refined_vectors_where_eigenvalues_lie_close(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    e, x = eigenvectors((a + a.T) / 2)
    order = np.argsort(-np.array(values), kind="stable")
    gap = np.diff(np.sort(values)).min()
    assert np.abs(e - np.array(values)[order]).max() < 1e-17 * max(values)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-15
    assert np.minimum(np.abs(x - q[:, order]), np.abs(x + q[:, order])).max() < 1e-17 * max(values) / gap
    plain = np.linalg.eigh(a.astype(np.float64))[1][:, ::-1]
    off = np.minimum(np.abs(plain - q[:, order]), np.abs(plain + q[:, order])).max()
    assert np.minimum(np.abs(x - q[:, order]), np.abs(x + q[:, order])).max() < off


def test_equal_eigenvalues_share_any_basis():
    e, x = eigenvectors(np.diag([1.0, 1.0, 2.0, 1.0]))
    assert e.tolist() == [2, 1, 1, 1] and np.abs(x.T @ x - np.eye(4)).max() < 1e-17
    e, x = eigenvectors(np.zeros((3, 3)))
    assert e.tolist() == [0, 0, 0]
