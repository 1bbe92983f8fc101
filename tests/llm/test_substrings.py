import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowgrain.llm.queries_dedup import op6
from flowgrain.llm.substrings import remove_repeats, repeated_spans

from .cases import AWKWARD, SMALL, folder, frame

SPACE = "\t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def plain(docs, k=13):
    """{doc: (words, removed, kept)} by listing every window; docs: {id: text}."""
    first, out = {}, {}
    words = {d: split(t) for d, t in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i:i + k]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = plain(docs)
    assert any(x[1] for x in want.values())
    assert {r.doc_id: tuple(r)[1:] for r in op6(spark, SMALL).collect()} == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("aab c dä e.".split()), max_size=40), min_size=2, max_size=12))
def test_few_words_many_repeats(spark, texts):
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    found = remove_repeats(frame(spark, list(docs.values())), window=5, anchor=2).collect()
    want = plain(docs, 5)
    for r in found:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == want[r.doc_id]


def test_awkward_rows(spark, tmp_path):
    texts = [*AWKWARD, "p q r s t u v w x y z 1 2 3", "0 p q r s\tt u v w x y z 1\n2 3 4", "é " * 13, "é " * 14]
    docs = frame(spark, texts).selectExpr("*", "1 as doc", "2 as mark", "3 as spans", "4 as anchor")
    rows = op6(spark, folder(tmp_path, spark, documents=docs)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == plain(dict(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"w{i}" for i in range(3, 30))
    docs = spark.createDataFrame([(5, text), (5, text), (5, other), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(-1, 0, 0), (-1, 20, 20), (5, 20, 0), (5, 20, 0), (5, 27, 0)]


def test_spans_name_their_source(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = frame(spark, [f"x y z {shared} end", f"{shared} tail", "a " + shared])
    got = {r.doc: [tuple(s) for s in r.spans] for r in repeated_spans(docs).collect()}
    assert got == {1: [(0, 60, 0, 3)], 2: [(1, 60, 0, 3)]}


def test_empty_table(spark, tmp_path):
    assert op6(spark, folder(tmp_path, spark, documents=frame(spark, []))).count() == 0
