"""Media columns: texts as lossless FLAC streams, and PCM blocks read back from them.

Method. ``to_flac`` stores a payload as a stream of 8-bit mono samples: fixed linear
predictors, Rice-coded residuals, checksummed frames and a seek table. ``to_pcm`` decodes
the Rice residuals and the predictors, verifies header, frame and stream checksums, and
gives blocks of samples with their sample offsets and the byte offsets of their frames, so
that a reader can seek.

Size. Rows are independent: no shuffle. A task holds one Arrow batch of rows and works on a
bounded number of frames at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, text_of, texts
from .flac import FRAME, Broken, Decoded, decode, encode

#: Most samples of a PCM block; whole frames.
PCM_BLOCK = 5461 * FRAME
BLOCKS = "array<struct<sample_offset:bigint,byte_offset:bigint,samples:bigint,pcm:binary>>"
_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int64()),
                              ("pcm", pa.binary())]))


def payload(text: bytes) -> bytes:
    """The text, filled with spaces to a positive multiple of the frame size."""
    return text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def to_flac(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text, any other columns).

    n_bytes is the UTF-8 size of the text without filling. Null and empty texts become one
    frame of spaces. Repeated rows and null ids stay. An empty table gives an empty one.
    """
    batches_of(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch, "text")
            made = encode([payload(t) for t in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(made, pa.binary())],
                ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, media binary")


def _blocks(found: Decoded, block: int) -> list[dict]:
    """PCM blocks of whole frames, about ``block`` samples each."""
    if not len(found.samples):
        return []
    ends = np.cumsum(found.samples)
    unit = len(found.pcm) // int(ends[-1])
    starts = ends - found.samples
    firsts = np.flatnonzero(np.diff(starts // block, prepend=-1))
    cuts = [*starts[firsts].tolist(), int(ends[-1])]
    return [{"sample_offset": a, "byte_offset": at, "samples": b - a, "pcm": found.pcm[a * unit:b * unit]}
            for a, b, at in zip(cuts[:-1], cuts[1:], found.offsets[firsts].tolist(), strict=True)]


def _one(stream: bytes | None) -> tuple[Decoded | None, str | None]:
    if stream is None:
        return None, "no stream"
    try:
        return decode([stream])[0], None
    except (Broken, ValueError, IndexError) as problem:
        return None, str(problem)


def to_pcm(media: DataFrame, block: int = PCM_BLOCK) -> DataFrame:
    """``media`` (a binary column media, any others) with blocks, features and error.

    blocks are the samples in order with their places. features are whole numbers of the
    samples around silence: energy (sum of squares), crossings (changes of sign) and peak.
    A null or broken stream, or one that fails a checksum, has null blocks and features and
    says why in error. Columns already named like the new ones are replaced.
    """
    batches_of(media.sparkSession)
    plain = media.drop("blocks", "energy", "crossings", "peak", "error")
    names = plain.columns
    at = names.index("media")
    inner = [f"c{i}" for i in range(len(names))]
    kinds = ", ".join(f"{i} {f.dataType.simpleString()}" for i, f in zip(inner, plain.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(at).to_pylist()
            try:
                found = [(d, None) for d in decode(streams)]
            except (Broken, ValueError, IndexError, TypeError):
                found = [_one(s) for s in streams]
            blocks, features, errors = [], [], []
            for d, problem in found:
                errors.append(problem)
                blocks.append(None if d is None else _blocks(d, block))
                if d is None:
                    features.append((None, None, None))
                    continue
                x = np.frombuffer(d.pcm, np.uint8).astype(np.int32) - 128
                features.append((int((x * x).sum(dtype=np.int64)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))),
                                 int(np.abs(x).max(initial=0))))
            more = [pa.array(blocks, _BLOCKS), *[pa.array([f[i] for f in features], pa.int64()) for i in range(3)],
                    pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more],
                                             [*inner, "blocks", "energy", "crossings", "peak", "error"])

    return plain.toDF(*inner).mapInArrow(
        run, f"{kinds}, blocks {BLOCKS}, energy long, crossings long, peak long, error string").toDF(
            *names, "blocks", "energy", "crossings", "peak", "error")
