"""Near copies by the Jaccard similarity of their five-word shingles.

Method. A document is the set of hashes of its shingles of ``WORDS`` lowercased words.
SimHash fingerprints of the sets are compared exactly, tile against tile (``simhash``), in a
radius that holds a pair of similarity 0.8 but for a chance of 1e-5. This gives groups of
candidates; an exact check follows. A few candidate links of each document are decided by the
sets. What then still stands in different groups of near copies is laid into tiles that
carry the sets, and tile is compared with tile in numpy: pairs of one group, of too different
sizes or of too many differing bits are skipped, all others decided by the exact similarity of
the sets. So two documents within the radius are in one group or were compared.

Size. Texts with equal words meet once, as one 128-bit hash of their words. Compared
fingerprints grow with the square of the documents of similar size. A tile holds a bounded
number of documents and of shingles, and only a spanning forest of its links leaves the task,
so no list of pairs is made; the work on sets grows with the square of a group of candidates
only where its members are similar but no near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.scale import salted_join

from .common import batches_of, parts, release, rows_of, shielded, store, text_of
from .graph import components
from .simhash import NEAR, NEAR_SHORT, SHORT, mixed, set_fingerprint, set_links

#: Words of a shingle; near copies share EQUAL[0] of EQUAL[1] parts of both sets together.
WORDS, EQUAL = 5, (4, 5)
#: Candidate links of a document that are decided before tiles are made.
LINKS = 3
#: Documents and shingles of a tile.
TILE, TILE_SHINGLES = 512, 1 << 20


def words_of(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


def shingles(found: list[str]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle has are one."""
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    k = min(WORDS, len(found))
    n = len(found) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mixed(total + hashes[i:i + n] + np.uint64(i + 1))
    return np.unique(total)


def near(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with ``both`` members in common are near copies;
    two empty sets are."""
    return both * EQUAL[1] >= EQUAL[0] * (a + b - both)


def _signed(docs: DataFrame) -> DataFrame:
    """(copy, node, n, bits) of every row of ``docs`` (copy, text): a hash of the words, number
    and fingerprint of the shingles."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bits = [], [], []
            for _, text in rows_of([batch], "copy", "text"):
                found = words_of(text)
                held = shingles(found)
                nodes.append(xxhash.xxh3_128_digest(" ".join(found)))
                sizes.append(len(held))
                bits.append(set_fingerprint(held).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(bits, pa.binary())], ["copy", "node", "n", "bits"])

    return docs.mapInArrow(run, "copy binary, node binary, n long, bits binary")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, n, bits, held): size, fingerprint and shingles of ``docs`` (node, n, bits, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(words_of(text)).astype("<u8").tobytes() for _, text in rows_of([batch], "node", "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary())], ["node", "n", "bits", "held"])

    return docs.select("node", "n", "bits", "text").mapInArrow(run, "node binary, n long, bits binary, held binary")


def _some_of(candidates: DataFrame) -> DataFrame:
    """At most ``LINKS`` links (u, v) of each document, drawn by hash, however many it has."""
    both = candidates.union(candidates.select("v", "u"))
    drawn = [F.min(F.struct(F.xxhash64("u", "v", F.lit(seed)).alias("at"), "v")).alias(f"x{seed}") for seed in range(LINKS)]
    each = both.groupBy("u").agg(*drawn).select("u", F.explode(F.array(*[F.col(f"x{seed}.v") for seed in range(LINKS)])).alias("v"))
    return each.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _decided(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The links (u, v) of ``pairs`` that are near copies."""
    sides = [held.select(F.col("node").alias(name), F.col("held").alias(side)) for name, side in (("u", "a"), ("v", "b"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(bool(near(both, len(x), len(y))))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return store(pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "a", "b").mapInArrow(
        run, "u binary, v binary"))


def _forest(a: tuple, b: tuple) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the near pairs of two tiles (roots, fingerprints, sets)
    that are not yet of one group."""
    sizes = [np.array([len(s) for s in t[2]], np.int64) for t in (a, b)]
    flat, starts = np.concatenate([*b[2], np.zeros(1, "<u8")]), np.cumsum([0, *sizes[1][:-1]])
    names, number = np.unique(np.array([*a[0], *b[0]]), return_inverse=True)
    group = np.arange(len(names))
    left, right = number[:len(a[0])], number[len(a[0]):]
    us, vs = [], []
    for i, held in enumerate(a[2]):
        n, m = sizes[0][i], sizes[1]
        wanted = (group[right] != group[left[i]]) & near(np.minimum(n, m), n, m)
        if not wanted.any():
            continue
        at = np.flatnonzero(wanted)
        most = np.where(np.minimum(n, m[at]) <= SHORT, NEAR_SHORT[1], NEAR[1])
        at = at[np.bitwise_count(b[1][at] ^ a[1][i]).sum(axis=1) <= most]
        if not len(at):
            continue
        hit = np.concatenate(([0], np.cumsum(np.isin(flat, held))))
        both = hit[starts[at] + m[at]] - hit[starts[at]]
        for j in at[near(both, n, m[at])].tolist():
            p, q = group[left[i]], group[right[j]]
            if p != q:
                group[group == q] = p
                us.append(i)
                vs.append(j)
    return us, vs


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for row in batch.to_pylist():
            sides = []
            for side in ("a", "b"):
                members = row[side]
                sides.append(([m["root"] for m in members],
                              np.array([np.frombuffer(m["bits"], "<u8") for m in members]),
                              [np.frombuffer(m["held"], "<u8") for m in members]))
            left, right = _forest(*sides)
            us += [row["a"][i]["node"] for i in left]
            vs += [row["b"][j]["node"] for j in right]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])


def _in_tiles(placed: DataFrame, held: DataFrame) -> DataFrame:
    """Links of near copies within the groups of candidates of ``placed`` (band, node, root)
    whose members stand in more than one group of near copies."""
    spark = placed.sparkSession
    rows = placed.join(held.select("node", "n"), "node")
    cuts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    open_bands = store(rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), cuts.alias("cuts"))
                       .where("low <> high").select("band", "cuts"))
    cut = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("cuts")).cast("int")
    open_ = salted_join(placed, open_bands, ["band"], "inner").withColumn("cut", cut)
    each = F.collect_list(F.struct("node", "root", "bits", "held"))
    tiles = store(open_.join(held.select("node", "bits", "held"), "node").groupBy("band", "cut").agg(
        each.alias("rows"), F.max("cuts").alias("cuts")))
    out = tiles.select("band", "cut", F.col("rows").alias("a"),
                       F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).where("cut <= other")
    right = tiles.select("band", F.col("cut").alias("other"), F.col("rows").alias("b"))
    count = max(parts(spark), 2 * spark.sparkContext.defaultParallelism)
    pairs = out.repartition(count, "band", "other").join(right, ["band", "other"]).select("a", "b")
    batches_of(spark, 1)
    links = store(pairs.mapInArrow(_compare, "u binary, v binary"))
    batches_of(spark)
    release(open_bands, tiles)
    return links


def _rooted(known: DataFrame, edges: DataFrame) -> DataFrame:
    named = components(edges).select("node", "root")
    return known.join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))


def copy_of(id_name: str, text: Column) -> Column:
    """128-bit hash of a row's id and text; a null id is no string."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_name).cast("string")), F.lit("null")),
                                  F.lit("\n"), text)))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near copies: of each group of
    documents linked by pairs of similarity 0.8 or more the row of the least doc_id (null
    last), and of rows equal in doc_id and text one. Null and empty texts and such without
    words are one group. An empty table gives an empty one.
    """
    inner = shielded(docs, "doc_id", "text")
    keyed = inner.withColumn("copy", copy_of("doc_id", text_of(F.col("text"))))
    plain = keyed.select("copy", text_of(F.col("text")).alias("text"))
    signed = store(_signed(plain))
    known = store(signed.groupBy("node").agg(F.min("copy").alias("copy"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    candidates = set_links(known.select("node", "n", "bits"), EQUAL)
    grouped = store(components(candidates).select(F.col("root").alias("band"), "node"))
    wanted = known.join(grouped.select("node"), "node", "left_semi")
    held = store(_sets(plain.join(wanted, "copy").dropDuplicates(["node"])))
    links = _decided(_some_of(candidates), held)
    placed = store(_rooted(grouped, links))
    more = _in_tiles(placed, held)
    label = _rooted(known.select("node"), links.union(more))
    ids = keyed.select("copy", "doc_id").distinct().join(signed.select("copy", "node").distinct(), "copy")
    stay = store(ids.join(label, "node").groupBy("root").agg(
        F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "copy")).alias("first")).select("first.copy"))
    release(signed, known, candidates, grouped, held, placed, links, more)
    kept = keyed.join(stay, "copy", "left_semi").dropDuplicates(["copy"])
    return kept.select(*inner.columns).toDF(*docs.columns)
