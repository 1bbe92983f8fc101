import os
import zlib
from collections import defaultdict

from flowgrain.llm import sharding
from flowgrain.llm.queries_layout import SHARDS, op3
from flowgrain.llm.sharding import external_shuffle, write_shards

from .cases import AWKWARD, SMALL, folder, frame


def slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    return {s: sorted(x) for s, x in by.items()}


def test_query_keeps_the_law(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op3(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < SHARDS and r.grown_shard in (r.shard, SHARDS)
    assert any(r.grown_shard == SHARDS for r in rows)
    assert all(x == list(range(len(x))) for x in slots(rows).values())


def test_slots_do_not_depend_on_the_input_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    run = lambda df: {(r.doc_id, r.shard, r.slot) for r in external_shuffle(df, 3, bucket=20000).collect()}
    a, b = run(docs), run(docs.orderBy("n_chars", "doc_id").repartition(7))
    assert a == b and len(a) == docs.count()
    order = sorted((slot, doc) for doc, shard, slot in a if shard == 0)
    assert [d for _, d in order] != sorted(d for _, d in order)


def test_a_hot_key_spreads_over_buckets(spark):
    docs = frame(spark, [f"text number {i} " * 20 for i in range(400)]).selectExpr("1L as doc_id", "text")
    rows = external_shuffle(docs, 4, bucket=5000).collect()
    assert {tuple(x) for x in slots(rows).values()} == {tuple(range(400))}


def test_equal_rows_spread_over_buckets(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 1000, 5, id) as doc_id", "if(id < 1000, 'same text', 'other ' || id) as text",
                                        "cast(if(id < 1000, 1, id) as int) as extra")
    kept = sharding._fisher_yates
    monkeypatch.setattr(sharding, "_fisher_yates", lambda seed, schema: measured(kept(seed, schema)))
    rows = external_shuffle(docs, 3, bucket=20_000).collect()
    assert len(rows) == 3000 and all(x == list(range(len(x))) for x in slots(rows).values())
    assert sum(r.extra == 1 for r in rows) == 1000
    hot = sorted(r.slot for r in rows if r.text == "same text")
    assert hot[-1] - hot[0] > 1000  # spread over the whole shard


def measured(run):
    def call(key, rows, base):
        assert rows.num_rows * 30 < 40_000  # twice the target of a bucket
        return run(key, rows, base)
    return call


def test_awkward_rows(spark, tmp_path):
    docs = frame(spark, AWKWARD + AWKWARD[:1]).selectExpr("*", "9 as shard", "'x' as slot", "1 as `a.b`")
    same = docs.union(docs.where("doc_id = 7")).union(docs.where("doc_id = 7").selectExpr(
        "cast(null as long)", "text", "lang", "source", "n_chars", "shard", "slot", "`a.b`"))
    rows = external_shuffle(same, 5).collect()
    assert len(rows) == len(AWKWARD) + 3
    assert all(x == list(range(len(x))) for x in slots(rows).values())
    assert op3(spark, folder(tmp_path, spark, documents=docs.drop("a.b"))).count() == len(AWKWARD) + 1
    out = os.path.join(str(tmp_path), "out")
    write_shards(frame(spark, AWKWARD), out, 3)
    assert spark.read.parquet(out).count() == len(AWKWARD)


def test_empty_table(spark, tmp_path):
    assert op3(spark, folder(tmp_path, spark, documents=frame(spark, []))).count() == 0
