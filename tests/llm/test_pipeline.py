import zlib

import corpus_pipeline
from flowgrain.llm.common import store, table
from flowgrain.llm.decontaminate import edits_allowed, words_of
from flowgrain.llm.simhash import one_of_each_group

from .cases import AWKWARD, folder, frame
from .test_decontaminate import nearest
from .test_nearcopies import survivors
from .test_packing import tokens
from .test_pii import base

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept, frames = [{r.doc_id: r.text for r in docs.collect()}], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, frames[-1], SF))
        assert out.columns == names
        frames.append(out)
        kept.append({r.doc_id: r.text for r in out.collect()})
        assert len(kept[-1]) == out.count()
    before, no_toxic, single, clean, hidden = kept
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert all(no_toxic[d] == before[d] for d in no_toxic)
    gone = set(before) - set(no_toxic)
    assert len([d for d in gone if labels.get(d) == 0]) <= 1
    assert set(single) == survivors(no_toxic) and len(single) < len(no_toxic)
    items = [words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, t in single.items() if any(
        nearest(i, words_of(t)) <= edits_allowed(len(i)) for i in items if len(set(i) & set(words_of(t))) > len(i) / 3)}
    assert set(clean) == set(single) - leaked and leaked
    assert set(hidden) == set(clean)
    assert not any(k in ("email", "ip") for t in hidden.values() for k, *_ in base(t))
    assert all(hidden[d] == t for d, t in clean.items() if not base(t))
    assert all(r.n_chars == len(r.text) for r in frames[-1].collect())
    got = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, frames[-1], SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(hidden)
    for d, pieces in got.items():
        ids, at = tokens(hidden[d]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)


def test_run_on_awkward_rows(spark, tmp_path):
    docs = frame(spark, AWKWARD).union(frame(spark, AWKWARD[7:9], 7)).union(frame(spark, ["lost", "lost"]).selectExpr(
        "cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    sf = folder(tmp_path, spark, documents=docs, labels=labels, benchmark=items)
    ids = [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(None) == 1
    empty = folder(tmp_path, spark, documents=frame(spark, []))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(5, "alpha beta gamma"), (5, "alpha beta gamma"), (5, "other words entirely here"),
                                  (None, "alpha beta gamma"), (None, "only one of these"), (None, "only one of these")],
                                 "doc_id long, text string").selectExpr("*", "1 as copy", "2 as root", "3 as `a.b`")
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [
        (0, "only one of these"), (5, "alpha beta gamma"), (5, "other words entirely here")]


def test_personal_data_without_lengths(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now"), (2, None), (None, "")], "doc_id long, text string")
    got = corpus_pipeline.hide_personal_data(spark, docs, SF)
    assert got.columns == docs.columns
    found = {r.doc_id: r.text for r in got.collect()}
    assert "a@b.co" not in found[1] and found[2] is None and found[None] == ""
