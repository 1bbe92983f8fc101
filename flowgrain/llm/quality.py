"""Document quality by votes of the nearest labelled documents in a latent-semantic space.

Method. A document is a bag of hashed words and of signs of form (shares of symbols,
capitals, digits and repeats, in steps). Terms are weighted by their inverse document
frequency over all documents; a truncated singular value decomposition of a sample of
labelled rows gives the latent space. The labelled vectors are broadcast, and every document
meets all of them: exact cosines, block of documents by matrix of labelled vectors. The
``NEIGHBOURS`` nearest vote with their labels, weighted by a power of their cosine.

Size. Texts are read twice and never shuffled; document frequencies are at most ``TERMS``
sums. The labelled sample is at most ``SAMPLE`` rows, lowest hash first, whatever the input,
so what is broadcast is at most SAMPLE * RANK + TERMS * RANK numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, text_of

#: Labelled rows kept, dimensions of the space, neighbours that vote.
SAMPLE, RANK, NEIGHBOURS = 6000, 32, 15
#: Hashed word terms, and the terms of form after them: kinds times steps.
WORDS, STEPS = 1 << 14, 8
FORMS = ("symbols", "capitals", "digits", "repeats", "variety", "length", "lines", "marks", "size", "bars")
TERMS = WORDS + STEPS * len(FORMS)
#: Documents projected at once.
BLOCK = 128
#: Weight of a form term beside a word term; power of the cosine in a vote.
FORM_WEIGHT, SHARPNESS = 3.0, 8
_CAPITALS, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "_.,;:'\"()!?-")


def _share(text: bytes, of: bytes) -> float:
    """Share of the bytes of a text that are among ``of``."""
    return 1 - len(text.translate(None, of)) / max(1, len(text))


def _step(share: float) -> int:
    """Step of a share: 0 for none, then doubling from 1/128."""
    return 0 if share <= 0 else int(min(STEPS - 1, max(1, np.ceil(np.log2(min(1.0, share) * 128)) + 1)))


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, each once, and their weights in the text."""
    words = text.split()
    n = len(words)
    size = max(1, len(text))
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, n) & (WORDS - 1)
    found, count = np.unique(hashed, return_counts=True)
    again = int((hashed[1:] == hashed[:-1]).sum()) if n else 0
    steps = (_step(_share(text, _SYMBOLS) * 2), _step(_share(text, _CAPITALS)), _step(_share(text, _DIGITS)), _step(again / max(1, n)), _step(1 - len(found) / max(1, n)),
             min(STEPS - 1, int(size / max(1, n) / 2)), _step(text.count(b"\n") / max(1, n)),
             _step(_share(text, _MARKS) * 4), min(STEPS - 1, int(np.log2(n + 1) / 2)),
             _step(text.count(b"|") / max(1, n)))
    forms = WORDS + np.arange(len(FORMS)) * STEPS + np.array(steps)
    weights = np.concatenate((np.log1p(count) / np.sqrt(max(1.0, np.log1p(count).sum())), np.full(len(FORMS), FORM_WEIGHT)))
    return np.concatenate((found, forms)), weights


@dataclass
class Space:
    """The latent space and the labelled vectors in it; bounded by SAMPLE, TERMS and RANK."""
    idf: np.ndarray
    basis: np.ndarray  # TERMS, RANK
    vectors: np.ndarray  # rows, RANK, of length 1
    labels: np.ndarray

    def project(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Vectors of length 1; a document without weight in the space is all zero. The rows of
        the terms, many times the documents, are held for ``BLOCK`` documents at once."""
        out = np.empty((len(docs), self.basis.shape[1]), np.float32)
        for low in range(0, len(docs), BLOCK):
            block = docs[low:low + BLOCK]
            sizes = np.array([len(t) for t, _ in block])
            terms = np.concatenate([t for t, _ in block])
            rows = self.basis[terms]
            rows *= (np.concatenate([w for _, w in block]) * self.idf[terms]).astype(np.float32)[:, None]
            np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0, out=out[low:low + BLOCK])
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the neighbours of each document."""
        if not docs or not len(self.labels):
            return np.full(len(docs), 0.5)
        cosine = self.project(docs) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        pull = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-9
        return (pull * self.labels[near]).sum(axis=1) / pull.sum(axis=1)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                held[terms_of(text)[0]] += 1
            rows += batch.num_rows
        held[TERMS] = rows  # the last entry counts the rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    sums = docs.select(text_of(F.col("text")).alias("text")).mapInArrow(run, "term int, n long")
    held = np.zeros(TERMS + 1, np.int64)
    for r in sums.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most TERMS + 1 rows
        held[r.term] = r.n
    return held[:TERMS], int(held[TERMS])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Space:
    """Space of ``docs`` (doc_id, text) with the vectors of at most ``sample`` rows of
    ``labels`` (doc_id, label)."""
    held, rows = frequencies(docs)
    idf = np.log((rows + 1) / (held + 1)) + 0.1
    known = (labels.select("doc_id", "label").where("label in (0, 1)").groupBy("doc_id")
             .agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high")
             .select("doc_id", F.col("low").cast("int").alias("label")))
    hashed = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), text_of(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.astype("<i4").tobytes() for t, _ in found], pa.binary()),
                 pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary())], ["h", "label", "terms", "weights"])

    # the lowest hashes are found among ids alone; only the texts below them are joined
    last = (hashed.select("doc_id", "h").join(known, "doc_id").select("h").orderBy("h").limit(sample)
            .agg(F.max("h").alias("h")).first()["h"])
    got = [] if last is None else hashed.where(F.col("h") <= last).join(known, "doc_id").select("h", "label", "text").mapInArrow(
        run, "h long, label int, terms binary, weights binary").orderBy("h", "terms").limit(sample).collect()
    bags = [(np.frombuffer(r.terms, "<i4").astype(np.int64), np.frombuffer(r.weights, "<f4").astype(float)) for r in got]
    truth = np.array([r.label for r in got], float)
    space = Space(idf, np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), truth)
    if bags:
        space.basis = _basis(bags, idf, rank)
        space.vectors = space.project(bags)
    return space


def _basis(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors of the weighted rows, by subspace iteration with a fixed start."""
    sizes = np.array([len(t) for t, _ in bags])
    terms = np.concatenate([t for t, _ in bags])
    weight = np.concatenate([w for _, w in bags]) * idf[terms]
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bags)), sizes)
    norms = np.sqrt(np.add.reduceat(weight ** 2, first))
    weight = weight / norms[owner]
    basis = np.random.default_rng(5).standard_normal((len(idf), rank + 8))
    for _ in range(rounds):
        right = np.empty((len(bags), basis.shape[1]))
        for c in range(basis.shape[1]):
            right[:, c] = np.add.reduceat(basis[terms, c] * weight, first)
        left = np.empty_like(basis)
        for c in range(basis.shape[1]):
            left[:, c] = np.bincount(terms, weights=right[owner, c] * weight, minlength=len(idf))
        basis, values = np.linalg.qr(left)
    # order by strength and keep the strongest
    small = np.stack([np.add.reduceat(basis[terms, c] * weight, first) for c in range(basis.shape[1])], axis=1)
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    found = (basis @ turn.T)[:, :rank].astype(np.float32)
    return np.pad(found, ((0, 0), (0, rank - found.shape[1])))  # fewer rows than dimensions


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> DataFrame:
    """(doc_id, score) of ``docs`` (doc_id, text, any others): the weighted share of label 1
    among the nearest rows of ``labels`` (doc_id, label, any others).

    Null and empty texts have terms of form only and are scored like any other. Labels other
    than 0 and 1, and a doc_id with both, are no labels; without labels the score is 0.5. Rows
    with a null or repeated doc_id are scored like any other. An empty table gives an empty one.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, sample, rank))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms_of(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fitted.value.score(bags), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
