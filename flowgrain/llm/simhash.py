"""Near-duplicates by SimHash fingerprints compared exactly, tile against tile.

Method. A fingerprint is the bitwise majority of the 64-bit hashes of a document's word
shingles. Distinct fingerprints are laid into tiles of equal population counts (set bits of
each of three parts of the word). Two fingerprints within ``radius`` bits have counts that
differ by at most ``radius`` in total, so tile pairs beyond that are skipped and all others
are compared in full with numpy exclusive-or and bit counts. Nothing is sampled or capped.

Size. Equal fingerprints meet once. A tile holds about ``TILE`` fingerprints; a fuller count
key is cut by hash into several tiles, so a tile pair is a bounded task. Of a tile pair's
links only a spanning forest leaves the task, so a group of near copies does not become all
its pairs. Compared pairs still grow with the square of the distinct fingerprints, at about
a tenth of all pairs.

Wider links. ``set_links`` compares sets of hashes in the same way by fingerprints of
``WIDE`` words. Its tiles are made by size, so that sizes no near copies can have skip a
tile pair; within one, rows are skipped by the population count of the first word, others
by its differing bits, and the bits of all words decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, parts, release, rows_of, shielded, store, text_of
from .graph import components

#: Seed of the shingle hash, words of a shingle, and most differing bits of a link.
SEED, WORDS, RADIUS = 42, 3, 3
#: Fingerprints of a tile.
TILE = 2048
#: Bit ranges whose population counts name a tile.
RANGES = ((0, 21), (21, 21), (42, 22))
#: Rows of a tile compared at once with the whole other tile.
STRIPE = 64
#: Words of the fingerprint of a set, and its members that are hashed at once.
WIDE, CHUNK = 4, 4096
#: Fingerprints of a tile of sets; growth of the size from one tile key to the next but one.
SET_TILE, GROWTH = 4096, 1.26
#: Most differing bits of the first word and of all words of two sets with 8 of 9 members
#: in common, missed with chance 1e-5 (binomial; 0.15 a bit), and the same up to SHORT
#: members, where ties are frequent (0.19 a bit).
NEAR, NEAR_SHORT, SHORT = (23, 72), (32, 84), 16
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, WIDE), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of one UTF-8 text; a text without words has 0, one with fewer
    words than a shingle has the hash of all of them."""
    found = text.lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(found) - k + 1
    for low in range(0, n, 65536):
        high = min(n, low + 65536)
        spans = zip(starts[low:high].tolist(), ends[low + k - 1:high + k - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with their bits spread."""
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def set_fingerprint(held: np.ndarray) -> np.ndarray:
    """The ``WIDE`` words of the fingerprint of a set of 64-bit hashes: bitwise majorities of
    its members, each hashed once a word. An empty set has 0."""
    total = np.zeros(64 * WIDE, np.int64)
    for low in range(0, len(held), CHUNK):
        h = mixed(held[low:low + CHUNK, None] * _TIMES + _PLUS).astype("<u8")
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(held), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, copy, fp) of every whole text; copy is a hash of id and text, fp the
    fingerprint as a signed 64-bit number."""
    batches_of(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for _, t in rows_of([batch], "doc_id", "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                                             ["doc_id", "copy", "fp"])

    text = text_of(F.col("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("copy"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, copy long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs of ``a`` and ``b`` within ``radius`` bits."""
    root = np.arange(len(b))
    left: list[int] = []
    right: list[int] = []
    for low in range(0, len(a), STRIPE):
        near = np.bitwise_count(a[low:low + STRIPE, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            js = np.flatnonzero(near[i])
            roots, first = np.unique(root[js], return_index=True)
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
            left += [low + i] * len(roots)
            right += js[first].tolist()
    x, y = a[np.array(left, np.int64)], b[np.array(right, np.int64)]
    return x[x != y], y[x != y]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            sides = [batch.column(i) for i in (0, 1)]
            offsets = [s.offsets.to_numpy() for s in sides]
            values = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sides]
            for r in range(batch.num_rows):
                x, y = _forest(values[0][offsets[0][r]:offsets[0][r + 1]],
                               values[1][offsets[1][r]:offsets[1][r + 1]], radius)
                if len(x):
                    xs.append(x)
                    ys.append(y)
            if xs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(side).view(np.int64)) for side in (xs, ys)], ["u", "v"])
    return run


def _tiles(keyed: DataFrame, cell: list[str], by: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """Tiles (key, cut, cells) of about ``tile`` rows of ``keyed`` and the cuts of each key;
    the few keys are safe to broadcast."""
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    one = F.col(cell[0]) if len(cell) == 1 else F.struct(*cell)
    tiles = (keyed.join(F.broadcast(sizes), "key")
             .withColumn("cut", F.pmod(F.xxhash64(by, F.lit("tile")), F.col("cuts")).cast("int"))
             .groupBy("key", "cut").agg(F.collect_list(one).alias("cells")))
    return sizes, store(tiles)


def _tile_pairs(sizes: DataFrame, tiles: DataFrame, steps: list[int]) -> DataFrame:
    """Cells (a, b) of every pair of tiles whose keys differ by one of ``steps``, each once."""
    spark = tiles.sparkSession
    deltas = F.array(*[F.lit(step) for step in steps])
    out = (tiles.select("key", "cut", F.col("cells").alias("a"), F.explode(deltas).alias("step"))
           .withColumn("other", F.col("key") + F.col("step"))
           .join(F.broadcast(sizes.select(F.col("key").alias("other"), "cuts")), "other")
           .withColumn("other_cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
           .where("step <> 0 or cut <= other_cut"))
    n = max(parts(spark), 2 * spark.sparkContext.defaultParallelism)
    right = tiles.select(F.col("key").alias("other"), F.col("cut").alias("other_cut"), F.col("cells").alias("b"))
    return out.repartition(n, "other", "other_cut").join(right, ["other", "other_cut"]).select("a", "b")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``prints`` (fp). Their connected
    components are those of all pairs within ``radius`` bits."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))) for low, n in RANGES]
    keyed = prints.select("fp", (counts[0] * 10000 + counts[1] * 100 + counts[2]).cast("int").alias("key"))
    # at most 22 * 22 * 23 keys whatever the input
    sizes, tiles = _tiles(keyed, ["fp"], "fp", tile)
    steps = [(a, b, c) for a, b, c in itertools.product(range(-radius, radius + 1), repeat=3)
             if abs(a) + abs(b) + abs(c) <= radius and (a, b, c) >= (0, 0, 0)]
    pairs = _tile_pairs(sizes, tiles, [a * 10000 + b * 100 + c for a, b, c in steps])
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def _set_forest(a: tuple, b: tuple, share: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the pairs of two tiles of sets (sizes, words of the
    fingerprints) within ``NEAR`` bits whose sizes allow near copies; ``b`` is in order of the
    population counts of its first words."""
    first, most = NEAR_SHORT if min(a[0].min(), b[0].min()) <= SHORT else NEAR
    ones = [np.bitwise_count(side[1][:, 0]).astype(np.int64) for side in (a, b)]
    heads = [np.ascontiguousarray(side[1][:, 0]) for side in (a, b)]
    root = np.arange(len(b[0]))
    left, right = [], []
    order = np.argsort(ones[0], kind="stable")
    for low in range(0, len(order), STRIPE):
        rows = order[low:low + STRIPE]
        start = int(np.searchsorted(ones[1], ones[0][rows[0]] - first, "left"))
        end = int(np.searchsorted(ones[1], ones[0][rows[-1]] + first, "right"))
        i, j = np.nonzero(np.bitwise_count(heads[0][rows, None] ^ heads[1][None, start:end]) <= first)
        j += start
        n, m = a[0][rows[i]], b[0][j]
        fit = np.minimum(n, m) * share[1] >= np.maximum(n, m) * share[0]
        i, j = i[fit], j[fit]
        fit = np.bitwise_count(a[1][rows[i]] ^ b[1][j]).sum(axis=1) <= most
        i, j = i[fit], j[fit]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for at, js in zip(i[np.concatenate(([0], cuts))].tolist() if len(i) else [], np.split(j, cuts), strict=False):
            roots, one = np.unique(root[js], return_index=True)
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
            left += [int(rows[at])] * len(roots)
            right += js[one].tolist()
    return left, right


def set_links(prints: DataFrame, share: tuple[int, int], tile: int = SET_TILE) -> DataFrame:
    """Links (u, v) between the sets of ``prints`` (node, n, bits): their names, sizes and
    fingerprints. The connected components are those of all pairs of different sets within
    ``NEAR`` bits whose sizes allow the Jaccard similarity ``share`` of at least 4 to 5."""
    keyed = prints.withColumn("key", F.when(F.col("n") > 0, F.floor(
        F.log(F.col("n").cast("double")) * F.lit(2 / np.log(GROWTH)))).otherwise(-9).cast("int"))
    sizes, tiles = _tiles(keyed, ["node", "n", "bits"], "node", tile)
    batches_of(prints.sparkSession, 16)

    def sides(cells: pa.ListArray, r: int) -> tuple[list, tuple]:
        held = cells.values.slice(cells.offsets[r].as_py(), cells.offsets[r + 1].as_py() - cells.offsets[r].as_py())
        bits = np.frombuffer(b"".join(held.field(2).to_pylist()), "<u8").reshape(-1, WIDE)
        order = np.argsort(np.bitwise_count(bits[:, 0]), kind="stable")
        return held.field(0).take(pa.array(order)).to_pylist(), (held.field(1).to_numpy()[order], bits[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for r in range(batch.num_rows):
                (x, a), (y, b) = sides(batch.column(0), r), sides(batch.column(1), r)
                for i, j in zip(*_set_forest(a, b, share), strict=True):
                    if x[i] != y[j]:
                        us.append(x[i])
                        vs.append(y[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    found = store(_tile_pairs(sizes, tiles, [0, 1, 2]).mapInArrow(run, "u binary, v binary"))
    release(tiles)
    batches_of(prints.sparkSession)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED,
                    tile: int = TILE) -> DataFrame:
    """(doc_id, copy, fp, root, component_id) of every row of ``docs`` (doc_id, text, any
    other columns); root names the group by its least fingerprint.

    component_id is the least doc_id that can be reached over links of at most ``radius``
    bits. Null and empty texts have fingerprint 0 and are linked like any other. A null
    doc_id keeps its row and never names a component unless all its members are null.
    Repeated rows stay repeated. An empty table gives an empty one.
    """
    prints = store(fingerprints(docs, words, seed))
    known = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(store(links(known, radius, tile)))
    member = known.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    label = member.join(named, "root").select("fp", "root", "component_id")
    return prints.join(label, "fp").select("doc_id", "copy", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the least
    doc_id (null last), and of rows equal in doc_id and text one. Other columns stay."""
    inner = shielded(docs, "doc_id", "text")
    found = near_duplicates(inner, **options)
    stay = store(found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "copy")).alias(
        "first")).select("first.copy"))
    keyed = inner.withColumn("copy", F.xxhash64("doc_id", text_of(F.col("text"))))
    kept = keyed.join(stay, "copy", "left_semi").dropDuplicates(["copy"])
    return kept.select(*inner.columns).toDF(*docs.columns)
