"""Repeated passages over the words of all documents, by compacted de Bruijn paths.

Method. Windows of ``WINDOW`` consecutive words are the edges of a de Bruijn graph, joined
where the next window follows. Along a document, consecutive edges that share their least
``ANCHOR``-word hash form one path; equal word runs always cut into equal paths, but for
their ends. So

1. paths whose anchor stands in one document only cannot repeat and leave at once;
2. the rest compact by content: equal paths become one, with the first place that has it;
3. an anchor with one path does not branch: all its edges have that first place. Where paths
   branch, the compacted ones are opened into edges, and each edge takes the least first
   place of all paths through it; edges in step with one source are one segment again;
4. joined back to where the paths occur, segments with a source in a smaller document are
   the repeated spans; source coordinates join neighbours on one diagonal to long spans.

Equality of paths and edges is that of 120 hash bits and more (an anchor and the windows).

Size. Two narrow shuffles of about a fifth of all word positions, then only what may repeat,
and twice the texts to meet their own places. The state between steps is Parquet in the
shared folder, deleted when it is no longer read. Groupings combine before the shuffle, so a
passage in a third of all documents is one row for each task; joins back are equi-joins with
one row for each key on the other side, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, store, text_of, texts

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 4
#: Bytes kept of a window's hash.
EDGE = 7
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LAST = (1 << 63) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    out = h[:len(h) - n + 1].copy()
    for j in range(1, n):
        out *= factor
        out += h[j:len(h) - n + 1 + j]
    return _mix(out)


@dataclass
class _Paths:
    """Paths of a batch of texts: arrays with one entry for each path."""
    doc: np.ndarray  # number of the text in the batch
    pos: np.ndarray  # first window, in words of the text
    size: np.ndarray  # windows
    anchor: np.ndarray
    flat: np.ndarray  # first window in the batch
    words: np.ndarray  # hashes of all words of the batch


def _paths_of(raw: list[bytes], window: int, anchor: int) -> _Paths | None:
    """Paths of all texts that hold a window; None if none does."""
    split = [t.split() for t in raw]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lengths.sum())
    words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, total)
    begin = np.cumsum(lengths) - lengths
    whole = np.maximum(lengths - window + 1, 0)  # windows of each text
    n = total - window + 1
    if not whole.any():
        return None
    grams = _grams(words, anchor, _FACTORS[0])
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - anchor + 1):
        other = grams[j:n + j]
        np.copyto(at, j, where=other < least)
        np.minimum(least, other, out=least)
    doc = np.repeat(np.arange(len(split)), whole)
    inside = np.repeat(begin - (np.cumsum(whole) - whole), whole) + np.arange(int(whole.sum()))
    at = at[inside] + inside  # places of anchors never repeat across texts
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    flat = inside[starts]
    return _Paths(doc[starts], flat - begin[doc[starts]], np.diff(starts, append=len(inside)), least[flat].view(np.int64),
                  flat, words)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): the id with null last, a hash of the text, and the text."""
    text = text_of(F.col("text"))
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"),
                       F.xxhash64(text).alias("mark"), text.alias("text"))


def _anchors(docs: DataFrame, window: int, anchor: int, places: bool) -> DataFrame:
    """(anchor, doc) of each path, or with content and place (anchor, content, doc, mark,
    pos, size). A path is shorter than a window, so its first and last window are all of it."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _paths_of(texts(batch, "text"), window, anchor)
            if p is None:
                continue
            doc = pa.array(p.doc)
            if places:
                edge = _grams(p.words, window, _FACTORS[1])
                ends = edge[p.flat] * _FACTORS[0] + edge[p.flat + p.size - 1]
                content = _mix(ends * _FACTORS[1] + p.size.astype(np.uint64)).view(np.int64)
                columns = [pa.array(p.anchor), pa.array(content), batch.column(0).take(doc), batch.column(1).take(doc),
                           pa.array(p.pos.astype(np.int32)), pa.array(p.size.astype(np.int32))]
            else:
                columns = [pa.array(p.anchor), batch.column(0).take(doc)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["anchor", "content", "doc", "mark", "pos", "size"] if places else ["anchor", "doc"]
    return _keyed(docs).mapInArrow(run, "anchor long, content long, doc long, mark long, pos int, size int"
                                   if places else "anchor long, doc long")


def _edges(docs: DataFrame, wanted: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, doc, mark, pos, path) of the paths of ``docs`` at the places ``wanted``
    (doc, mark, starts); path is the hashes of its windows, one after another."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _paths_of(texts(batch, "text"), window, anchor)
            if p is None:
                continue
            starts = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(starts).to_numpy())
            asked = owner << 40 | starts.flatten().to_numpy().astype(np.int64)
            keep = np.isin(p.doc << 40 | p.pos, asked)
            size, flat = p.size[keep], p.flat[keep]
            if not len(size):
                continue
            ends = np.cumsum(size)
            window_at = np.repeat(flat - (ends - size), size) + np.arange(int(ends[-1]))
            hashes = _grams(p.words, window, _FACTORS[1])[window_at]
            data = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :EDGE]).tobytes()
            offsets = np.concatenate(([0], ends * EDGE)).astype(np.int32)
            path = pa.BinaryArray.from_buffers(pa.binary(), len(size), [
                None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            doc = pa.array(p.doc[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.anchor[keep]), batch.column(0).take(doc), batch.column(1).take(doc), pa.array(p.pos[keep]),
                 path], ["anchor", "doc", "mark", "pos", "path"])

    return _keyed(docs).join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "starts").mapInArrow(
        run, "anchor long, doc long, mark long, pos long, path binary")


_SEGMENTS = "array<struct<n:int,size:int,source_doc:bigint,source_pos:bigint>>"


def _runs(segments: str, made: Callable[[Column, Column], Column]) -> Column:
    """``made(first, last)`` of each run of an array of segments (n, size, source_doc,
    source_pos) in order; a run goes on where the next segment begins at the end of the one
    before, in the text and in its source. Both ends of all runs are found by looking at
    neighbours, so the work is linear in the segments."""
    s, n = F.col(segments), F.size(segments)

    def goes_on(i: Column) -> Column:
        one, after = F.get(s, i), F.get(s, i + 1)
        return (after["n"] - one["n"] == one["size"]) & (after["source_doc"] == one["source_doc"]) & (
            after["source_pos"] - one["source_pos"] == one["size"])

    places = F.sequence(F.lit(0), n - 1)
    firsts = F.filter(places, lambda i: (i == 0) | ~goes_on(i - 1))
    lasts = F.filter(places, lambda i: (i == n - 1) | ~goes_on(i))
    return F.zip_with(firsts, lasts, lambda i, j: made(F.get(s, i), F.get(s, j)))


def _whole(first: Column, last: Column) -> Column:
    """One segment for a run of segments."""
    return F.struct(first["n"].alias("n"), (last["n"] + last["size"] - first["n"]).alias("size"),
                    first["source_doc"].alias("source_doc"), first["source_pos"].alias("source_pos"))


def _opened(docs: DataFrame, compact: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, mark, pos, segments): of the first place of each branching path, its segments of
    edges with the least place of every edge."""
    branching = compact.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = store(compact.join(branching, "anchor", "left_semi")
                   .groupBy(F.col("first.doc").alias("doc"), F.col("first.mark").alias("mark"))
                   .agg(F.collect_list("first.pos").alias("starts")))
    paths = _edges(docs, wanted, window, anchor)
    edges = store(paths.withColumn("n", F.explode(F.sequence(F.lit(0), (F.octet_length("path") / EDGE - 1).cast("int"))))
                  .select("anchor", F.expr(f"substring(path, n * {EDGE} + 1, {EDGE})").alias("edge"), "doc", "mark",
                          F.col("pos").cast("int").alias("pos"), "n"))
    least = edges.groupBy("anchor", "edge").agg(F.min(F.struct("doc", (F.col("pos") + F.col("n")).alias("pos"))).alias(
        "least"))
    one = F.struct("n", F.lit(1).alias("size"), F.col("least.doc").alias("source_doc"),
                   F.col("least.pos").cast("long").alias("source_pos"))
    opened = store(edges.join(least, ["anchor", "edge"]).groupBy("doc", "mark", "pos").agg(
        F.array_sort(F.collect_list(one)).alias("s")).select(
            "doc", "mark", "pos", _runs("s", _whole).cast(_SEGMENTS).alias("segments")))
    release(wanted, edges)
    return opened


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, mark, spans): for each document with repeats its word spans (start, length,
    source_doc, source_start) in order. Each span is one window or longer, its words stand
    from source_start on in the smallest document that has them; spans may overlap."""
    repeated = store(_anchors(docs, window, anchor, False).groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"))
    places = store(_anchors(docs, window, anchor, True).join(repeated.hint("shuffle_hash"), "anchor"))
    compact = store(places.groupBy("anchor", "content").agg(
        F.min(F.struct("doc", "pos", "mark")).alias("first"), F.max("doc").alias("high"), F.max("size").alias("size")))
    opened = _opened(docs, compact, window, anchor)
    whole = F.array(F.struct(F.lit(0).alias("n"), "size", F.col("first.doc").alias("source_doc"),
                             F.col("first.pos").cast("long").alias("source_pos"))).cast(_SEGMENTS)
    sources = (compact.select("*", "first.doc", "first.mark", "first.pos").join(opened, ["doc", "mark", "pos"], "left")
               .select("anchor", "content", "high", F.coalesce("segments", whole).alias("segments"))
               .withColumn("segments", F.filter("segments", lambda s: s["source_doc"] < F.col("high")))
               .where(F.size("segments") > 0).drop("high"))
    found = (places.join(store(sources), ["anchor", "content"])
             .select("doc", "mark", "pos", F.explode("segments").alias("s")).where("s.source_doc < doc")
             .select("doc", "mark", F.struct(
                 (F.col("pos") + F.col("s.n")).alias("n"), F.col("s.size").alias("size"),
                 F.col("s.source_doc").alias("source_doc"), F.col("s.source_pos").alias("source_pos")).alias("s")))
    spans = store(found.groupBy("doc", "mark").agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        "doc", "mark", _joined("s", window).alias("spans")))
    release(repeated, places, compact, opened)
    return spans


_SPANS = "array<struct<start:bigint,length:bigint,source_doc:bigint,source_start:bigint>>"


def _joined(segments: str, window: int) -> Column:
    """Spans in words of segments in order, neighbours in step with one source as one."""
    def span(first: Column, last: Column) -> Column:
        words = last["n"] + last["size"] - first["n"] + (window - 1)
        return F.struct(first["n"].alias("start"), words.alias("length"), first["source_doc"].alias("source_doc"),
                        first["source_pos"].alias("source_start"))
    return _runs(segments, span).cast(_SPANS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of ``docs`` (doc_id integer, text, any others).

    kept are the words no repeat covers, joined by one space; spans say where repeats stood
    and where each stands first. Null and empty texts have no words, texts shorter than a
    window no repeats. A null doc_id counts as larger than all; rows with equal doc_id are
    no repeats of each other. An empty table gives an empty one.
    """
    spans = repeated_spans(docs, window, anchor)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(F.col("text"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"),
                        F.xxhash64(text).alias("mark"), text.alias("text"))
    joined = keyed.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, found in zip(texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                keep = np.ones(len(words), bool)
                for s in found or ():
                    keep[s["start"]:s["start"] + s["length"]] = False
                left = int(keep.sum())
                gone.append(len(words) - left)
                words = words if left == len(words) else [words[i] for i in np.flatnonzero(keep).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 batch.column(2)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, spans {_SPANS}")
