import math
import tracemalloc
import zlib

import numpy as np

from flowgrain.llm import quality
from flowgrain.llm.queries_filters import op1
from flowgrain.llm.quality import NEIGHBOURS, SHARPNESS, TERMS, Space, fit, frequencies, score, terms_of

from .cases import AWKWARD, folder, frame

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op1(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for _, p, y in held) / len(held) >= 0.95
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) >= 0.97


def test_blocked_votes_against_one_by_one():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    space = Space(np.ones(TERMS), rng.standard_normal((TERMS, 8)).astype(np.float32), vectors, rng.integers(0, 2, 300).astype(float))
    docs = [terms_of(f"text {i} {'x ' * i}".encode()) for i in range(40)]
    got = space.score(docs)
    for d, s in zip(docs, got, strict=True):
        v = sum(space.basis[t].astype(float) * w for t, w in zip(*d, strict=True))
        cosines = [(float(np.dot(v, u) / math.sqrt(np.dot(v, v))), y) for u, y in zip(vectors.astype(float), space.labels, strict=True)]
        near = sorted(cosines, reverse=True)[:NEIGHBOURS]
        pull = [max(c, 0) ** SHARPNESS + 1e-9 for c, _ in near]
        assert abs(s - sum(p * y for p, (_, y) in zip(pull, near, strict=True)) / sum(pull)) < 1e-4


def test_frequencies_count_every_document(spark):
    texts = ["a b", "a", None, "a a c"] * 30
    held, rows = frequencies(frame(spark, texts))
    want = np.zeros(TERMS, np.int64)
    for t in texts:
        want[terms_of((t or "").encode())[0]] += 1
    assert rows == 120 and (held == want).all()


def test_basis_is_the_leading_part_of_the_decomposition():
    docs = [terms_of(("good words here " * (i % 5) + f"n{i % 7}").encode()) for i in range(60)]
    basis = quality._basis(docs, np.ones(TERMS), 5, rounds=12)
    dense = np.zeros((60, TERMS))
    for r, (t, w) in enumerate(docs):
        dense[r, t] = w / np.linalg.norm(w)
    _, values, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.linalg.norm(dense @ basis, axis=0), values[:5], rtol=1e-3)


def test_sample_is_bounded(spark):
    docs = frame(spark, [f"text {i}" for i in range(50)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    assert fit(docs.select("doc_id", "text"), labels, sample=20).vectors.shape == (20, quality.RANK)


def test_awkward_rows(spark, tmp_path):
    good = [f"A calm sentence about thing number {i}." for i in range(80)]
    bad = [f"$$$ ### %%% {i} $$$ $$$" for i in range(80)]
    texts = [*AWKWARD, *good, *bad]
    docs = frame(spark, texts).selectExpr("*", "1 as label", "2 as score", "3 as h")
    n = len(AWKWARD)
    labels = docs.where(f"doc_id >= {n}").selectExpr("doc_id", f"cast(doc_id < {n + 80} as int) as quality", "0 as toxic", "'x' as text")
    rows = {r.doc_id: r for r in op1(spark, folder(tmp_path, spark, documents=docs, labels=labels)).collect()}
    assert len(rows) == len(texts)
    assert all(rows[n + i].predicted == 1 for i in range(80)) and not any(rows[n + 80 + i].predicted for i in range(80))


def test_unknown_labels_null_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, label int")
    assert [r.score for r in score(docs, none).collect()] == [0.5] * 4
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1(spark, folder(tmp_path, spark, documents=frame(spark, []), labels=labels)).count() == 0


def test_projection_holds_few_rows_of_terms():
    rng = np.random.default_rng(4)
    space = Space(np.ones(TERMS), rng.standard_normal((TERMS, 32)).astype(np.float32), np.zeros((0, 32), np.float32), np.zeros(0))
    docs = [(rng.integers(0, TERMS, 200), rng.random(200)) for _ in range(1500)]
    tracemalloc.start()
    got = space.project(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 200 * 32 * 4 / 3  # the rows of all terms would be three times this
    for (terms, weights), row in list(zip(docs, got, strict=True))[::250]:
        plain = (space.basis[terms].astype(float) * weights[:, None]).sum(axis=0)
        assert np.allclose(row, plain / np.linalg.norm(plain), atol=1e-5)
