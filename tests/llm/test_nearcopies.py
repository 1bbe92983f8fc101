import random

import numpy as np

import corpus_pipeline
from flowgrain.llm import nearcopies, simhash
from flowgrain.llm.common import table
from flowgrain.llm.graph import components
from flowgrain.llm.nearcopies import one_of_each_group

from .cases import AWKWARD, frame


def plain_sets(texts):
    out = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        k = min(5, len(w))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def survivors(texts):
    """Least ids of the groups by comparing all pairs."""
    sets, root = plain_sets(texts), {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            small, large = sorted((len(x), len(y)))
            if small >= 0.8 * large and (not large or len(x & y) >= 0.8 * len(x | y)):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d for d in texts if root[d] == d}


def test_stage_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == survivors(texts)


def test_chains_groups_and_awkward_rows(spark):
    draw = random.Random(7)
    base = [f"w{draw.randrange(9999)}" for _ in range(200)]
    texts = list(AWKWARD)
    for n in range(40):
        copy = base[:]
        for at in draw.sample(range(200), n % 6):
            copy[at] = f"new{n}"
        texts.append(" ".join(copy))
    moving = base[:100]
    for n in range(30):
        moving = moving[4:] + [f"step{n}.{i}" for i in range(4)]
        texts.append(" ".join(moving))
    docs = frame(spark, texts).selectExpr("*", "1 as node", "2 as copy", "3 as `a.b`")
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(survivors(dict(enumerate(texts))))


def test_common_passage_below_the_threshold(spark, monkeypatch):
    """Texts that share most of a passage fill buckets without being near copies."""
    monkeypatch.setattr(nearcopies, "TILE", 16)
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for n in range(120):
        own = [f"own{n}.{i}" for i in range(40)]
        texts.append(" ".join(passage + own))
        if n % 10 == 0:
            own[draw.randrange(40)] = "changed"
            texts.append(" ".join(passage + own))
    kept = sorted(r.doc_id for r in one_of_each_group(frame(spark, texts)).collect())
    assert kept == sorted(survivors(dict(enumerate(texts)))) and len(kept) == 120


def test_empty_table(spark):
    assert one_of_each_group(frame(spark, [])).count() == 0


def test_candidates_come_from_fingerprints_of_simhash(spark):
    """Every pair of sets of similarity 0.8 is joined by the tiled comparison, whatever the tile."""
    draw = np.random.default_rng(11)
    sets = []
    for size in (4, 5, 9, 30, 200, 1500) * 4:
        held = draw.integers(0, 1 << 64, size, np.uint64)
        sets += [held, held[:-(size // 5)] if size >= 5 else held[:-1], np.append(held, draw.integers(0, 1 << 64, size // 4, np.uint64))]
    rows = [(i.to_bytes(2, "big"), len(s), simhash.set_fingerprint(s).tobytes()) for i, s in enumerate(sets)]
    prints = spark.createDataFrame(rows, "node binary, n long, bits binary")
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in simhash.mixed(s * simhash._TIMES[0] + simhash._PLUS[0])) > len(s))
             for s in sets[:6]]
    assert plain == [int(simhash.set_fingerprint(s)[0]) for s in sets[:6]]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if nearcopies.near(
        len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert len(near) > 24
    for tile in (4, 4096):
        root = {bytes(r.node): bytes(r.root) for r in components(simhash.set_links(prints, nearcopies.EQUAL, tile)).collect()}
        assert all(root[rows[i][0]] == root[rows[j][0]] for i, j in near)
        assert len(set(root.values())) >= 24


def test_stage_takes_its_candidates_from_simhash(spark, monkeypatch):
    asked = []
    made = simhash.set_links
    monkeypatch.setattr(nearcopies, "set_links", lambda *a: asked.append(1) or made(*a))
    docs = frame(spark, ["one two three four five six", "one two  three four five SIX", "other words here"])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2] and asked
