import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgrain.llm.packing import END, TIERS, encoder, fill, pack, public_vocabulary
from flowgrain.llm.queries_layout import op7

from .cases import AWKWARD, SMALL, folder, frame


def tokens(text):
    import public_tokenizers as p
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [END]


def check(rows, docs):
    """All that the pieces of packed ``docs`` {id: text} promise."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids, at = tokens(docs[d]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= TIERS[-1]
        short += at not in TIERS
    return short


def test_query_against_tokenizer(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check(op7(spark, SMALL).collect(), docs) <= 8


def test_awkward_rows(spark, tmp_path):
    texts = [*AWKWARD, "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext", "<|endoftext|>\n", "y" * 40000, "1 2  3   4\n\n\n5"]
    docs = frame(spark, texts).selectExpr("*", "1 as ids", "2 as start", "3 as sequence_id")
    rows = op7(spark, folder(tmp_path, spark, documents=docs)).collect()
    assert check(rows, dict(enumerate(texts))) <= 8
    twice = frame(spark, ["a b", "a b"]).selectExpr("cast(null as long) as doc_id", "text")
    assert pack(twice).count() == 2


def test_empty_table(spark, tmp_path):
    assert op7(spark, folder(tmp_path, spark, documents=frame(spark, []))).count() == 0


def test_step_groups_are_even(spark):
    rows = pack(frame(spark, ["word " * 5000] * 30).coalesce(1), step=8192).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.step_group] += r.length
    assert sorted(size.values())[1:] == [8192] * (len(size) - 1)


def test_tiers_must_be_powers(spark):
    with pytest.raises(ValueError):
        pack(frame(spark, []), tiers=(100, 2048))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=40), st.booleans())
def test_fill_keeps_every_token(lengths, last):
    windows, left = fill([(n, i, 0) for i, n in enumerate(lengths)], last=last)
    got = defaultdict(list)
    for w in windows:
        for d, s, n in w:
            got[d].append((s, n))
    for n, d, s in left:
        got[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(got[d]):
            assert s == at and k > 0
            at += k
        assert at == n
    sizes = [sum(x[2] for x in w) for w in windows]
    assert sum(s not in TIERS for s in sizes) <= (1 if last else 0)
    assert not (last and left)


def test_encoder_is_cached():
    assert encoder(*public_vocabulary()) is encoder(*public_vocabulary())
