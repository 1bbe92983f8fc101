"""Hierarchical multi-length packing of token sequences.

Method. Each document becomes token ids plus an end id. Whole stretches of the longest
context size leave at once as full windows. What is left of a document is routed to the
smallest context tier (a power of two) that holds it. Windows are opened from the longest
tier down: each takes the longest open rest of its tier, its gap is filled from shorter
rests, best fit first, and what still gapes is filled by cutting one more rest. So every
window is filled to its tier size; only the last of a task can stay short and is padded.
Windows are then dealt in order of size into step groups of equal token counts.

Size. Documents are packed where they are read: no shuffle, and a task holds one block of
``BLOCK`` tokens (or one document) at a time; open rests of a block carry over to the next.
Padding is at most one window for each task. Sequence ids are made from the number of the
task and a count, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, text_of, texts

#: Context sizes, shortest first.
TIERS = (256, 512, 1024, 2048)
#: Id that ends every document.
END = 1
#: Tokens of a block that is packed together.
BLOCK = 1 << 19
#: Tokens of a step group.
STEP = 16 * 2048


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, tokenizer: str):
    """Byte-pair encoder over a vocabulary file of ranks. It gives the ids of the same
    vocabulary's ``tokenizer`` file, whose added tokens are tokens wherever a text holds them."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(tokenizer, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={t["content"]: t["id"] for t in added})


def public_vocabulary() -> tuple[str, str, str]:
    """Rank file, split pattern and tokenizer file of the 50k byte vocabulary, found on the
    machine that asks."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
            public_tokenizers.path("byte_bpe_50k.json"))


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """Smallest tier that holds ``length`` tokens."""
    return next(t for t in tiers if length <= t)


def fill(rests: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS, last: bool = False):
    """Windows from open rests (length, document, start), each at most the longest tier.

    Returns (windows, rests left over); a window is a list of (document, start, length).
    All windows are full but, with ``last``, at most one; else what would be short stays open.
    """
    open_, windows = sorted(rests), []
    while open_:
        length, doc, start = open_.pop()
        size = tier_of(length, tiers)
        gap, window = size - length, [(doc, start, length)]
        while gap and open_:
            at = bisect_right(open_, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                n, d, s = open_.pop(at)
                window.append((d, s, n))
                gap -= n
            else:
                n, d, s = open_.pop(0)
                window.append((d, s, gap))
                insort(open_, (n - gap, d, s + gap))
                gap = 0
        if gap and not last:
            return windows, [(n, d, s) for d, s, n in window]
        windows.append(window)
    return windows, []


class _Packer:
    """Packs the documents of one task; keeps the ids of documents with open rests."""

    def __init__(self, tiers: tuple[int, ...], step: int, task: int):
        self.tiers, self.step, self.base = tiers, step, task << 33
        self.made = self.tokens = self.held = 0
        self.docs: dict[int, tuple[object, np.ndarray]] = {}
        self.rests: list[tuple[int, int, int]] = []
        self.full: list[list[tuple[int, int, int]]] = []
        self.count = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        longest, n, doc = self.tiers[-1], len(ids), self.count
        self.docs[doc] = (doc_id, ids)
        self.count += 1
        self.held += n
        whole = n - n % longest
        self.full += [[(doc, s, longest)] for s in range(0, whole, longest)]
        if n > whole:
            self.rests.append((n - whole, doc, whole))

    def flush(self, last: bool) -> list[list]:
        """Columns of the pieces of all windows that are ready."""
        windows, self.rests = fill(self.rests, self.tiers, last)
        windows, self.full = self.full + windows, []
        windows.sort(key=lambda w: -sum(x[2] for x in w))
        out: list[list] = [[] for _ in range(9)]
        for window in windows:
            offset, size = 0, sum(x[2] for x in window)
            tier = tier_of(size, self.tiers)
            for doc, start, length in window:
                doc_id, ids = self.docs[doc]
                row = (doc_id, start, length, ids[start:start + length].tobytes(), len(ids), self.base + self.made,
                       offset, tier, self.base + self.tokens // self.step)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                offset += length
            self.made += 1
            self.tokens += size
        keep = {d for _, d, _ in self.rests}
        self.docs = {d: x for d, x in self.docs.items() if d in keep}
        self.held = 0
        return out


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step: int = STEP, block: int = BLOCK,
         vocabulary=public_vocabulary) -> DataFrame:
    """Pieces of packed sequences of ``docs`` (doc_id, text, any other columns).

    One row for each piece: doc_id, start (the document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence),
    tier (its context size) and step_group. Null and empty texts are one end id. Rows with a
    null or repeated doc_id are packed like any other. An empty table gives an empty one.
    ``tiers`` are powers of two. ``vocabulary`` is called on the executor and names the
    vocabulary files there.
    """
    if list(tiers) != sorted({t for t in tiers if t > 0 and t & (t - 1) == 0}):
        raise ValueError("tiers are rising powers of two")
    batches_of(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(n, k) for n, k in (
        ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
        ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.LongType()), ("step_group", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary()).encode_to_numpy
        packer = _Packer(tiers, step, TaskContext.get().partitionId())
        kinds = None

        def columns(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                              schema.names)
        for batch in batches:
            long = pa.int64()
            kinds = [batch.schema.field(0).type, long, long, pa.binary(), long, long, long, long, long]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                ids = encode(text.decode("utf-8", "replace"), allowed_special="all")
                packer.add(doc_id, np.append(ids, END).astype("<u4"))
                if packer.held >= block:
                    yield columns(packer.flush(False))
        if kinds:
            yield columns(packer.flush(True))

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(run, schema)
