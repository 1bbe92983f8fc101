import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from flowgrain.llm.queries_filters import op4
from flowgrain.llm.toxicity import (VOTERS, Voters, _tree, fit_and_score, fit_labels, fit_linear,
                                    term_statistics)

from .cases import AWKWARD, folder, frame

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p == y for _, p, y in held) / len(held)
    assert right >= 0.9
    toxic, clean = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) >= 0.75
    assert not sum(p for _, p, y in held if not y) > 0.03 * len(clean)


def test_term_counts_against_plain(spark):
    texts = [("a vile thing", 1), ("the vile thing", 1), ("Six VILE b", 1), ("one vile x", 1), ("five vile x", 1),
             ("a vile thing", 1), *[(f"clean text number {i}", 0) for i in range(40)]]
    df = spark.createDataFrame(texts, "text string, label int")
    terms, toxic, clean, tested = term_statistics(df)
    assert (toxic, clean) == (6, 40)
    assert terms == [("vile", 5, 0)]
    assert tested == 1  # "thing" and "x" always follow the same word


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    n = 40000
    y = rng.random(n) < 0.2
    votes = np.zeros((n, VOTERS), int)
    fire = [(0.8, 0.02), (0.7, 0.05), (0.6, 0.01), (0.5, 0.1)]
    for j, (a, b) in enumerate(fire):
        votes[:, j] = rng.random(n) < np.where(y, a, b)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 3], 1 - votes[:, 3])  # follows voter 3 in either class
    counts = {}
    for i, v in enumerate(votes @ (1 << np.arange(VOTERS))):
        key = int(v), int(y[i]) if i % 4 == 0 else None  # a quarter is labelled
        counts[key] = counts.get(key, 0) + 1
    model = fit_labels([(m, known, c) for (m, known), c in counts.items()])
    assert abs(model.share - 0.2) < 0.05
    assert tuple(sorted((3, 4))) in [tuple(sorted(p)) for p in model.correlations()]
    guess = model.posterior(votes) > 0.5
    assert (guess == y).mean() > 0.9
    root = model.order[0]
    assert abs(model.table[root, 1, 0] - fire[root][0]) < 0.15


def test_tree_spans_all_voters():
    votes = np.random.default_rng(1).integers(0, 2, (50, 6))
    parent, order = _tree(votes, np.ones(50), np.full(50, 0.5))
    assert sorted(order) == list(range(6)) and sum(p < 0 for p in parent) == 1


def test_linear_fit_separates():
    rng = random.Random(2)
    rows = [[i % 2, 2 + rng.randrange(3)] for i in range(200)]
    w, b = fit_linear(rows, np.array([float(i % 2) for i in range(200)]), np.ones(200), 5)
    z = [b + sum(w[i] for i in r) for r in rows]
    assert all((x > 2) == (i % 2 == 1) and abs(x) > 2 for i, x in enumerate(z))


def test_a_word_anywhere_in_a_long_text_votes():
    voters = Voters.of(["vile", "^nast"])
    mask, terms = voters.vote("word " * 20000 + "VILE. nastyness")
    assert terms == [0, 1] and mask & 1
    assert voters.vote("") == (0, [])


def test_awkward_rows(spark, tmp_path):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    bad = [f"{name(i)} vile{i % 2 * 'r'} thing here" for i in range(60)]
    good = [f"{name(i)} mild thing here" for i in range(200)]
    texts = [*AWKWARD, *bad, *good]
    docs = frame(spark, texts).selectExpr("*", "1 as label", "2 as mask", "3 as score", "4 as h")
    n = len(AWKWARD)
    labels = docs.where(f"doc_id >= {n}").select("doc_id", F.lit(None).cast("int").alias("quality"), F.when(
        F.col("doc_id") < n + 60, 1).otherwise(0).alias("toxic"), F.lit("x").alias("text"))
    sf = folder(tmp_path, spark, documents=docs, labels=labels)
    rows = {r.doc_id: r for r in op4(spark, sf).collect()}
    assert len(rows) == len(texts)
    assert all(rows[n + i].predicted == 1 for i in range(60))
    assert not any(rows[i].predicted for i in [*range(n), *range(n + 60, len(texts))])


def test_unknown_labels_null_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, label int")
    got = fit_and_score(docs, none).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op4(spark, folder(tmp_path, spark, documents=empty, labels=labels)).count() == 0
