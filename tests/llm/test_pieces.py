import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowgrain.llm import pieces
from flowgrain.llm.common import table
from flowgrain.llm.pieces import decode_pieces, encode_pieces, model, public_model
from flowgrain.llm.queries_models import op11

from .cases import AWKWARD, SMALL, folder, frame

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_model())
OWN = model(public_model())


def same(text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert OWN.encode(text).tolist() == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([p.replace("▁", " ") for p in OWN.score][:4000]), max_size=12))
def test_pieces_in_a_row(parts):
    same("".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(OWN.pieces) - 1), max_size=20), st.lists(st.integers(3, 258), max_size=9))
def test_ids_that_no_text_gives(some, raw):
    for ids in (some + raw, raw + some, raw):
        assert OWN.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", " " * 900, "▁ ▁▁ x", "<s></s><unk><0x0A>", "x" * 3000,
                                  "\n\t \r\n", "日本語のテキスト" * 200, "\x00a", "ab" * 40000])
def test_long_and_odd_texts(text):
    same(text)


def test_matches_in_small_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 5)
    for text in ["internationalisation" * 9, "日本語テキスト" * 30, "aaaaaaaaaaaaaaaaaaaaaaaa", "übergrößenträger" * 5]:
        same(text)


def test_known_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    own = pieces.PieceModel(public_model())
    text = "the quick brown fox jumps over the lazy dog and the quick fox " * 3
    assert own.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_backtracking_gives_pieces_back():
    steps = [t for t in ("▁thethere", "▁anthropomorphic", "▁underestimated", "▁reregistration")
             if OWN.split(t) != greedy(t)]
    assert steps


def greedy(text):
    out = []
    while text:
        piece = next((text[:n] for n in range(min(16, len(text)), 0, -1) if text[:n] in OWN.score), text[0])
        out.append(piece)
        text = text[len(piece):]
    return out


def expected(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def test_query_against_the_library(spark):
    docs = table(spark, SMALL, "documents").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11(spark, SMALL).collect()}
    assert got == {r.doc_id: expected(r.text) for r in docs}


def test_awkward_rows(spark, tmp_path):
    docs = frame(spark, AWKWARD).unionByName(frame(spark, ["again"] * 3)).withColumn("ids", F.lit("clash"))
    docs = docs.withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    sf = folder(tmp_path, spark, documents=docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11(spark, sf).collect())
    assert got == sorted((str(r.doc_id), *expected(r.text)) for r in docs.collect())


def test_empty_table_and_null_ids(spark):
    docs = frame(spark, ["a b"])
    assert encode_pieces(docs.where("doc_id < 0")).collect() == []
    ids = encode_pieces(docs).select("doc_id", F.lit(None).cast("array<int>").alias("ids"), F.lit(1).alias("decoded"))
    assert [tuple(r) for r in decode_pieces(ids).collect()] == [(0, None, None)]
    assert decode_pieces(encode_pieces(docs, end=False)).first().decoded == "a b"
