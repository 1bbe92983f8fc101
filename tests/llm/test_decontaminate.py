import random

from flowgrain.llm import decontaminate as decontaminate_module
from flowgrain.llm.decontaminate import build, closest, decontaminate, edits_allowed, mark, words_of
from flowgrain.llm.queries_filters import op5

from .cases import AWKWARD, SMALL, folder, frame


def nearest(item, text):
    """Least edits between ``item`` and any stretch of ``text``, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(docs, items):
    """{(doc, item): edits} of every pair that is near enough, comparing all with all."""
    out = {}
    for d, text in docs.items():
        words = words_of(text)
        for i, item in items.items():
            w = words_of(item)
            if w and len(w) - sum(x in set(words) for x in w) <= edits_allowed(len(w)):
                edits = nearest(w, words)
                if edits <= edits_allowed(len(w)):
                    out[d, i] = edits
    return out


def read(spark, name, key):
    return {r[key]: r.text for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()}


def test_query_against_brute_force(spark):
    docs, items = read(spark, "documents", "doc_id"), read(spark, "benchmark", "item_id")
    want = plain(docs, items)
    assert want
    assert {(r.doc_id, r.item_id): r.edits for r in op5(spark, SMALL).collect()} == want


def test_recall_with_edits_at_the_limit(spark):
    """Items with random edits, put into other text: nearly all are found, none is invented."""
    rng = random.Random(4)
    items = list(read(spark, "benchmark", "item_id").items())
    filler = [w for _, t in items for w in t.split()]
    found = total = 0
    index = build(items)
    for share in (0.0, 0.1, 1.0):
        docs, truth = [], []
        for i, t in items * 3:
            w = t.split()
            for _ in range(int(edits_allowed(len(words_of(t))) * share)):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[at] = rng.choice(filler)
                elif kind == 1:
                    w.insert(at, "new")
                elif len(w) > 1:
                    del w[at]
            around = [rng.choice(filler) + "x" for _ in range(30)]
            docs.append(" ".join([*around[:15], *w, *around[15:]]))
            truth.append(i)
        got = index.search(docs)
        hit = sum(any(m["item_id"] == i for m in g) for i, g in zip(truth, got, strict=True))
        assert share == 1.0 or hit == len(docs)
        found, total = found + hit, total + len(docs)
        for d, g in zip(docs, got, strict=True):
            for m in g:
                assert m["edits"] == nearest(words_of(dict(items)[m["item_id"]]), words_of(d))
    assert found / total >= 0.97


def limit_copies(rng, item, n):
    """Copies of an item with as many edits as are allowed, in other text."""
    out = []
    for _ in range(n):
        w = item.split()
        for _ in range(edits_allowed(len(w))):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = ["new"] * rng.randrange(2)
        out.append(" ".join(["far"] * 20 + w + ["off"] * 20))
    return [t for t in out if nearest(words_of(item), words_of(t)) <= edits_allowed(len(item.split()))]


def test_a_long_item_among_short_ones_is_found():
    rng = random.Random(6)
    items = [(i, " ".join(f"s{i}.{j}x" for j in range(4))) for i in range(200)]
    long = " ".join(f"long{j}" for j in range(60))
    index = build([*items, (999, long)])
    assert len(set(index.needs.tolist())) > 1
    docs = limit_copies(rng, long, 300)
    hit = sum(any(m["item_id"] == 999 for m in found) for found in index.search(docs))
    assert hit >= 0.98 * len(docs)


def test_items_no_repetition_finds_are_compared_directly(monkeypatch):
    monkeypatch.setattr(decontaminate_module, "STEPS", (4,))
    rng = random.Random(8)
    long = " ".join(f"long{j}" for j in range(60))
    index = build([(1, long), (2, "four words are here")])
    assert index.direct and index.needs.max() == 4
    docs = limit_copies(rng, long, 40)
    assert all(any(m["item_id"] == 1 for m in found) for found in index.search([*docs, "x " + long]))
    assert [m["item_id"] for m in index.search(["so four words are here now"])[0]] == [2]


def test_closest_against_plain():
    rng = random.Random(9)
    for _ in range(200):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 15))]
        edits, a, b = closest(item, text)
        assert edits == nearest(item, text) == nearest(item, text[a:b]) and 0 <= a <= b <= len(text)


def test_awkward_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog today"), (2, None), (3, "..."),
                                   (4, "zebra"), (5, "The quick, brown fox jumps over the lazy dog today"),
                                   (None, "two words"), (6, "x" * 5000)], "item_id long, text string")
    items = items.selectExpr("*", "1 as doc_id", "2 as matches")
    texts = [*AWKWARD, "see: the quick brown FOX jumps over a lazy dog today!", "quick brown fox", "a Zebra.", "has two  words"]
    docs = frame(spark, texts).selectExpr("*", "1 as matches", "2 as item_id", "3 as `a.b`")
    sf = folder(tmp_path, spark, documents=docs.drop("a.b"), benchmark=items)
    n = len(AWKWARD)
    got = {(r.doc_id, r.item_id, r.edits) for r in op5(spark, sf).collect()}
    assert got == {(n, 1, 1), (n, 5, 1), (n + 2, 4, 0), (n + 3, None, 0), (5, 6, 0)}
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {n, n + 2, n + 3, 5}


def test_repeated_rows_and_null_ids(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two three four five six"), (3, "a"), (3, "a"), (None, None)],
                                 "doc_id long, text string")
    assert sorted(len(r.matches) for r in mark(docs, items).collect()) == [0, 0, 0, 1]
    assert decontaminate(docs, items).count() == 3


def test_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([], "item_id long, text string")
    assert mark(frame(spark, ["a b"]), items).first().matches == []
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op5(spark, folder(tmp_path, spark, documents=frame(spark, []), benchmark=full)).count() == 0
