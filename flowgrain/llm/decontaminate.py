"""Benchmark items inside documents, within an edit distance, by CGK embedding and LSH.

Method. An item of L words is found where some stretch of a document is within
``(1 - similarity) * L`` word edits of it. Windows of the item's own size are embedded by
the CGK random walk: at step t the current word is written out, and a random bit of (t,
word) says whether to move on, so equal stretches fall back into step after an edit and edit
distance becomes Hamming distance. Bit-sampling LSH reads a few written positions; windows
that agree with an item on one of the repetitions are candidates. The number of repetitions
follows, for items of each size, from the target recall and from the collision rate measured
on the items themselves with random edits at the limit; items of a size that no allowed number
finds often enough are compared with all windows of that size. Candidates are verified by
exact edit distance.

Before the walk, windows that hold too few word pairs of items of their size are left out.
That is exact: a stretch within d edits keeps at least L - 1 - 2d of an item's pairs.

Size. Documents are read once and not shuffled; no two documents meet. The items are a
stated query set: they go out in blocks of ``BLOCK_ITEMS``, one pass for each block, so what
is broadcast is bounded whatever the size of the benchmark. Every document, whole text and
window is searched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, shielded, text_of

#: Least similarity, 1 - edits / item words; recall aimed at for items with as many edits as
#: are allowed (fewer edits have more), on average over a size and for each item; sampled
#: positions of a key.
SIMILARITY, RECALL, LEAST, SAMPLES = 0.8, 0.99, 0.95, 1
#: Items of one block, and the longest item (in words) that goes to a block of its own size.
BLOCK_ITEMS = 1024
#: Windows that walk at once; repetitions to measure rates on, and those a size may have.
STRIPE, TRIAL = 512, 64
STEPS = (4, 8, 12, 16, 20, 24, 30, 36, 42, 48, 56, 64, 80, 96, 128, 192, 256)
SEED = 11
#: Windows on each side that the measured rate counts.
BESIDE = 3
MATCHES = "array<struct<item_id:bigint,start:bigint,length:bigint,edits:bigint>>"
_MATCHES = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "length", "edits")]))
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs and white space part them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()


def edits_allowed(length: int, similarity: float = SIMILARITY) -> int:
    return int(length * (1 - similarity) + 1e-9)


def closest(item: list[int], stretch: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``stretch`` nearest to ``item``; first on ties."""
    cost, start = [0] * (len(stretch) + 1), list(range(len(stretch) + 1))
    for i, word in enumerate(item, 1):
        before, before_start = cost[0], start[0]
        cost[0], start[0] = i, 0
        for j, other in enumerate(stretch, 1):
            best, at = before + (word != other or word == 0), before_start
            if cost[j] + 1 < best:
                best, at = cost[j] + 1, start[j]
            if cost[j - 1] + 1 < best:
                best, at = cost[j - 1] + 1, start[j - 1]
            before, before_start = cost[j], start[j]
            cost[j], start[j] = best, at
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    return cost[end], start[end], end


@dataclass
class Index:
    """A block of items, ready to search."""
    ids: list[int]
    items: list[list[int]]  # word numbers; 0 is any word that no item has
    words: dict[bytes, int]
    similarity: float
    samples: int
    seed: int
    repeats: int = 0

    def __post_init__(self):
        self.lengths = sorted({len(i) for i in self.items})
        self.classes = {n: c for c, n in enumerate(self.lengths)}
        size = len(self.words) + 2
        pairs: dict[int, set[int]] = {}
        for item in self.items:
            for a, b in zip(item, item[1:] if len(item) > 1 else [0], strict=False):
                pairs.setdefault(a * size + b, set()).add(self.classes[len(item)])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.member = np.zeros((len(self.pairs), len(self.lengths)), bool)
        for row, key in enumerate(self.pairs.tolist()):
            self.member[row, list(pairs[key])] = True
        kinds = np.array([self.classes[len(i)] for i in self.items])
        self.needs = np.full(len(self.lengths), self.repeats, np.int64)
        if not self.repeats:
            self._draw(TRIAL)
            rates = self._rates()
            self.needs = np.array([self._needed(rates[kinds == c]) for c in range(len(self.lengths))])
        # items that no number of repetitions finds often enough are compared with every window
        self.direct = {c: np.flatnonzero(kinds == c) for c in np.flatnonzero(self.needs == 0).tolist()}
        self.repeats = int(self.needs.max(initial=0))
        self._draw(self.repeats)
        flat = np.concatenate([np.array(i, np.int64) for i in self.items])
        ends = np.cumsum([len(i) for i in self.items])
        keys = self._keys(flat, ends - [len(i) for i in self.items], ends, kinds)
        used = np.flatnonzero(np.arange(self.repeats)[:, None] < self.needs[kinds][None, :])
        order = used[np.argsort(keys.ravel()[used], kind="stable")]
        self.keys = keys.ravel()[order]
        self.owner = (order % len(self.items)).astype(np.int64)

    @staticmethod
    def _needed(rates: np.ndarray) -> int:
        """Repetitions that items of one size need; 0 if the most are not enough."""
        for repeats in STEPS:
            found = 1 - (1 - rates) ** repeats
            if found.mean() >= RECALL and found.min() >= LEAST:
                return repeats
        return 0

    def _draw(self, repeats: int) -> None:
        rng = np.random.default_rng(self.seed)
        steps = self.lengths[-1] + 1
        self.factor = rng.integers(1, 1 << 63, (steps, repeats, 1), np.uint64) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, (steps, repeats, 1), np.uint64)
        spread = rng.random((repeats, self.samples))
        # the first half of the walk, in which it has had to get over fewer edits
        self.sampled = np.stack([(spread * n).astype(np.int64) for n in self.lengths])  # class, repeat, sample

    def _keys(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray,
              repeats: int | None = None) -> np.ndarray:
        """Keys (repeat, window) of windows of ``flat`` word numbers; the first ``repeats``."""
        repeats, n = self.factor.shape[1] if repeats is None else repeats, len(starts)
        out = np.empty((repeats, n), np.uint64)
        pad = len(self.words) + 1
        flat = np.append(flat, pad)
        for low in range(0, n, STRIPE):
            part = slice(low, min(n, low + STRIPE))
            begin, end, kind = starts[part], ends[part], classes[part]
            steps = self.lengths[int(kind.max())]
            # every other repetition walks from the end, so edits at either end leave half of them
            size, ahead = end - begin, (np.arange(repeats) % 2 == 0)[:, None]
            moved = np.zeros((repeats, len(begin)), np.int64)
            written = np.empty((steps, repeats, len(begin)), np.int32)
            for t in range(steps):
                place = np.where(ahead, begin + moved, end - 1 - moved)
                word = np.where(moved < size, flat[np.clip(place, 0, len(flat) - 1)], pad)
                written[t] = word
                moved += ((word.astype(np.uint64) * self.factor[t, :repeats] + self.shift[t, :repeats])
                          >> np.uint64(63)).astype(np.int64)
            key = np.repeat((kind.astype(np.uint64) + np.uint64(1))[None, :], repeats, axis=0)
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, repeats + 1, dtype=np.uint64)[:, None]
            rows, columns = np.arange(repeats)[:, None], np.arange(len(begin))[None, :]
            for s in range(self.samples):
                seen = written[self.sampled[kind, :repeats, s].T, rows, columns].astype(np.uint64)
                key = (key ^ seen) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            out[:, part] = key
        return out

    def _rates(self) -> np.ndarray:
        """For each item, the share of repetitions on which it is met by one of the windows
        that begin next to a copy of it with as many random edits as are allowed."""
        rng = np.random.default_rng(self.seed + 1)
        flat, starts, ends, kinds = [], [], [], []
        for item in self.items:
            changed = list(item)
            for _ in range(edits_allowed(len(item), self.similarity)):
                at = int(rng.integers(0, len(changed)))
                kind = rng.integers(0, 3)
                if kind == 0:
                    changed[at] = 0
                elif kind == 1:
                    changed.insert(at, 0)
                elif len(changed) > 1:
                    del changed[at]
            at = len(flat)
            flat += [*item, *[0] * BESIDE, *changed, *[0] * (BESIDE + len(item))]
            for begin in (at, *range(at + len(item), at + len(item) + 2 * BESIDE + 1)):
                starts.append(begin)
                ends.append(begin + len(item))
                kinds.append(self.classes[len(item)])
        keys = self._keys(np.array(flat, np.int64), np.array(starts), np.array(ends), np.array(kinds))
        keys = keys.reshape(len(keys), len(self.items), 2 * BESIDE + 2)
        return (keys[:, :, 1:] == keys[:, :, :1]).any(axis=2).mean(axis=0)

    def _windows(self, flat: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and classes of windows that hold enough word pairs of their class."""
        size = len(self.words) + 2
        after = np.append(flat[1:], 0)
        single = self.lengths[0] == 1
        known = np.flatnonzero((flat > 0) & ((after > 0) | single))
        starts, classes = [], []
        for one in ([False, True] if single else [False]):
            key = flat[known] * size + (0 if one else after[known])
            row = np.searchsorted(self.pairs, key)
            hit = row < len(self.pairs)
            hit[hit] = self.pairs[row[hit]] == key[hit]
            place, row = known[hit], row[hit]
            for c, n in enumerate(self.lengths):
                if one != (n == 1):
                    continue
                d = edits_allowed(n, self.similarity)
                need, span = max(1, n - 1 - 2 * d), max(1, n + d - 1)
                q = place[self.member[row, c]]
                if len(q) < need:
                    continue
                first, last = q[:len(q) - need + 1], q[need - 1:]
                low, high = last - span + 1, first  # starts whose span holds all of them
                near = low <= high
                low, high = np.maximum(low[near], 0), high[near]
                if len(low):
                    mark = np.zeros(len(flat) + 1, np.int32)
                    np.add.at(mark, low, 1)
                    np.add.at(mark, high + 1, -1)
                    found = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    starts.append(found)
                    classes.append(np.full(len(found), c))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(classes)

    def _runs(self, found: np.ndarray) -> np.ndarray:
        """Where the candidate starts of one document and item fall apart into places."""
        far = np.diff(found[2]) > 2 * np.array([len(i) for i in self.items])[found[1, 1:]]
        return np.flatnonzero(far | (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)) + 1

    def search(self, docs: list[str | None]) -> list[list[dict]]:
        """Matches of each text: the nearest place of every item that is near enough."""
        number = self.words.get
        listed = [[number(w, 0) for w in words_of(t)] for t in docs]
        lengths = np.array([len(x) for x in listed], np.int64)
        flat = np.fromiter((w for x in listed for w in (*x, 0)), np.int64, int(lengths.sum()) + len(docs))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        out: list[list[dict]] = [[] for _ in docs]
        starts, classes = self._windows(flat, begin)
        if not len(starts):
            return out
        doc = np.searchsorted(begin, starts, side="right") - 1
        stop = begin[doc] + lengths[doc]
        sizes = np.array(self.lengths)[classes]
        stops, windows, owners = np.minimum(starts + sizes, stop), [], []
        for repeats in np.unique(self.needs[classes]).tolist():
            at = np.flatnonzero(self.needs[classes] == repeats)
            if not repeats:
                for c, members in self.direct.items():
                    mine = at[classes[at] == c]
                    windows.append(np.repeat(mine, len(members)))
                    owners.append(np.tile(members, len(mine)))
                continue
            keys = self._keys(flat, starts[at], stops[at], classes[at], repeats)
            left, right = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            many = (right - left).ravel()
            hit = np.repeat(left.ravel() - np.cumsum(many) + many, many) + np.arange(many.sum())
            windows.append(at[np.repeat(np.tile(np.arange(len(at)), repeats), many)])
            owners.append(self.owner[hit])
        window, owner = np.concatenate(windows), np.concatenate(owners)
        found = np.unique(np.stack((doc[window], owner, starts[window] - begin[doc[window]])), axis=1)
        for part in np.split(found, self._runs(found), axis=1) if found.size else ():
            d, i, first = part[:, 0].tolist()
            item, last = self.items[i], int(part[2, -1])
            allowed = edits_allowed(len(item), self.similarity)
            low = max(0, first - allowed)
            stretch = listed[d][low:last + len(item) + allowed]
            if len(item) - (Counter(item) & Counter(stretch)).total() > allowed:
                continue  # every word that is missing costs an edit
            edits, a, b = closest(item, stretch)
            known = out[d][-1] if out[d] and out[d][-1]["item_id"] == self.ids[i] and out[d][-1]["row"] == i else None
            if edits <= allowed and (known is None or edits < known["edits"]):
                if known:
                    out[d].pop()
                out[d].append({"item_id": self.ids[i], "start": low + a, "length": b - a, "edits": edits, "row": i})
        for matches in out:
            for m in matches:
                del m["row"]
        return out


def build(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, samples: int = SAMPLES,
          seed: int = SEED, repeats: int = 0) -> Index | None:
    """Index of (item_id, text) rows; items without words are left out, None if none is left."""
    listed = [(i, words_of(t)) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))]
    listed = [(i, w) for i, w in listed if w]
    if not listed:
        return None
    words: dict[bytes, int] = {}
    for _, w in listed:
        for x in w:
            words.setdefault(x, len(words) + 1)
    return Index([i for i, _ in listed], [[words[x] for x in w] for _, w in listed], words, similarity, samples, seed,
                 repeats)


def mark(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (text, any others) with matches: (item_id, start, length, edits) of each item
    of ``benchmark`` (item_id, text, any others) found in the text, places in words.

    Null and empty texts, and items without words, match nothing. Repeated items match one
    by one. Empty tables on either side give empty matches. A column already named matches
    is replaced.
    """
    spark = docs.sparkSession
    batches_of(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(F.col("text")).alias("text"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    out = docs.drop("matches").withColumn("matches", F.array().cast(MATCHES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_ITEMS
        index = build([(r.item_id, r.text) for r in rows], similarity)
        if index is not None:
            out = _pass(out, spark.sparkContext.broadcast(index))
    return out


def _pass(docs: DataFrame, index) -> DataFrame:
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text, matches = names.index("text"), names.index("matches")
    kinds = ", ".join(f"{i} {f.dataType.simpleString()}" for i, f in zip(inner, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = index.value.search(batch.column(text).cast(pa.large_string()).to_pylist())
            columns = list(batch.columns)
            old = columns[matches].to_pylist()
            columns[matches] = pa.array([(a or []) + b for a, b in zip(old, found, strict=True)], _MATCHES)
            yield pa.RecordBatch.from_arrays(columns, inner)

    return docs.toDF(*inner).mapInArrow(run, kinds).toDF(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (text, any others) in which no item of ``benchmark`` is found.

    Null and empty texts stay, as do repeated rows; see ``mark`` for odd items and empty tables.
    """
    found = mark(shielded(docs, "text"), benchmark, similarity)
    return found.where(F.size("matches") == 0).drop("matches").toDF(*docs.columns)
