"""Repair of the turn structure of conversations by a parallel Viterbi search.

A repaired conversation is empty, or user and assistant turns by turns, maybe after one
system turn. Turns may be kept, given another role or deleted, and empty turns inserted; the
cheapest edits are wanted, of equally cheap ones the least in letters.

Method. The cost to finish from each of four states is a vector for each row. Rows are cut
into chunks, and each chunk runs backward from a speculative vector at its end. Fix-up passes
rerun a chunk from the vectors its successor really gives, beside the speculative run, and
stop as soon as the two vectors differ only by a constant (the rank of the chunk has
converged); passes end when no chunk needs another vector. The vectors that hold are found by
following the pointers from the last chunk (pointer doubling, so rounds grow with the
logarithm of the chunks). With them every chunk is traced from each state it may be entered
in, and the states that hold follow from the first chunk in the same way.

Size. Equal rows of a conversation are merged before anything is sorted, positions come from
the skew-safe ranking, and a chunk has a fixed number of rows, so a conversation that holds a
third of all rows is many tasks. One value of a conversation (its audit, a digest of its
text) is made by one task that streams over sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.scale import GROUP_ROWS, ranked

from .common import batches_of, parts, store, text_of

#: Rows of a chunk.
SIZE = 128
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn is put in.
FORCED = (USER, USER, ASSISTANT, USER)
#: Costs of the edits, and of keeping a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bits of a row's code above its role (user 0, assistant 1, system 2, other 3).
CUT, GONE = 4, 8
#: Costs to finish after the last row.
END = (0, 2 * INSERT, INSERT, 0)
#: White space.
BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def _kept(kind: int, state: int) -> int | None:
    """State after keeping a row of role ``kind``; None where it may not stand."""
    if kind == 0 and state != USER:
        return USER
    if kind == 1 and state == USER:
        return ASSISTANT
    return SYSTEM if kind == 2 and state == START else None


KEPT = [[_kept(kind, state) for state in range(4)] for kind in range(4)]


def before(code: int, after: Vector) -> Vector:
    """Costs to finish from before a row, given those from after it."""
    if code & GONE:
        return tuple(DELETE + v for v in after)
    extra, kept = TRUNCATED if code & CUT else 0, KEPT[code & 3]
    cost = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + extra + after[FORCED[state]])
        if kept[state] is not None:
            best = min(best, extra + after[kept[state]])
        cost.append(best)
    user, assistant = cost[USER], cost[ASSISTANT]
    cost[USER], cost[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for state in (START, SYSTEM):
        cost[state] = min(cost[state], INSERT + cost[USER])
    return tuple(cost)


def level(vector: Vector) -> tuple[Vector, int]:
    """The vector less its least entry, and that entry."""
    low = min(vector)
    return tuple(v - low for v in vector), low


def packed(vector: Vector) -> int:
    """A levelled vector as a number; its entries are at most three insertions."""
    return sum(v << 5 * i for i, v in enumerate(vector))


def unpacked(number: int) -> Vector:
    return tuple(number >> 5 * i & 31 for i in range(4))


def speculate(codes: list[int], start: int) -> tuple[int, int]:
    """(levelled vector before a chunk, constant) from the vector at its end."""
    vector, total = unpacked(start), 0
    for code in reversed(codes):
        vector, low = level(before(code, vector))
        total += low
    return packed(vector), total


def fix_up(codes: list[int], start: int, guess: int, out: int, shift: int) -> tuple[int, int]:
    """As ``speculate``, beside the known run from ``guess``, until the two differ only by a
    constant; what is left then is taken from the known run."""
    new, old, total, known = unpacked(start), unpacked(guess), 0, 0
    for code in reversed(codes):
        if new == old:
            return out, total + shift - known
        new, low = level(before(code, new))
        old, other = level(before(code, old))
        total, known = total + low, known + other
    return packed(new), total


def trace(codes: list[int], more: list[int], end: int, state: int, last: bool
          ) -> tuple[int, list[str], list[str]]:
    """(state after the chunk, edits of each row, turns each row gives).

    A turn is named u or a if it is inserted, U or A if a row is given that role, K if a row
    is kept. With ``last`` one more entry holds the insertions after the last row.
    """
    vectors = [unpacked(end)]
    for code in reversed(codes):
        vectors.append(before(code, vectors[-1]))
    vectors.reverse()
    edits, turns = [], []
    for i, code in enumerate(codes):
        now, after, letters, made = vectors[i], vectors[i + 1], "", ""
        extra = TRUNCATED if code & CUT else 0
        while True:
            if code & GONE or DELETE + after[state] == now[state]:
                letters += "D"
                break
            forced = FORCED[state]
            if INSERT + now[forced] == now[state]:
                letters, made, state = letters + "I", made + ("u" if forced == USER else "a"), forced
                continue
            kept = KEPT[code & 3][state]
            if kept is not None and extra + after[kept] == now[state]:
                letters, made, state = letters + "K", made + "K", kept
            else:
                letters, made, state = letters + "R", made + ("U" if forced == USER else "A"), forced
            break
        edits.append(letters + "D" * more[i])
        turns.append(made)
    if last:
        letters = made = ""
        while END[state]:
            state = FORCED[state]
            letters, made = letters + "I", made + ("u" if state == USER else "a")
        edits.append(letters)
        turns.append(made)
    return state, edits, turns


def key_of(name: str) -> Column:
    """The id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def marked(turns: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, pos, turn, role, text, n, code) of the distinct rows of every conversation of
    ``turns`` (conv_id, turn, role, text) in order of turn (null first), role and text; n is
    how often a row stands there, all but the first being duplicates."""
    rows = turns.groupBy(key_of("conv_id").alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text")).agg(F.count("*").alias("n"))
    rows = store(ranked(rows, ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos",
                        group_rows=group_rows))
    seen = rows.groupBy("key", "role", "text").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("new"))
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    blank, new = F.length(bare) == 0, F.coalesce("new", F.lit(False))
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    code = kind + F.when(blank | ~new, GONE).when(~ended, CUT).otherwise(0)
    return store(rows.join(seen, ["key", "pos"], "left").select(
        "key", "pos", "turn", "role", "text", "n", blank.alias("blank"), code.cast("int").alias("code")))


def chunked(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, chunk, first, last, codes, more, peek) of the rows of ``marked``; more counts the
    copies of a row, peek is the code of the row after the chunk."""
    of = F.floor((F.col("pos") - 1) / size).cast("long")
    own = rows.select("key", of.alias("chunk"), "pos", "code", (F.col("n") - 1).alias("more"))
    ahead = own.where((F.col("pos") > 1) & ((F.col("pos") - 1) % size == 0)).withColumn("chunk", F.col("chunk") - 1)
    each = F.sort_array(F.collect_list(F.struct("pos", "code", "more")))
    held = own.union(ahead).groupBy("key", "chunk").agg(each.alias("rows"))
    mine = F.slice("rows", 1, size)
    return store(held.select(
        "key", "chunk", mine["pos"][0].alias("first"), (F.size("rows") <= size).alias("last"),
        mine["code"].alias("codes"), mine["more"].alias("more"), F.get("rows", F.lit(size))["code"].alias("peek")))


def _run(chunks: DataFrame, fixing: bool) -> DataFrame:
    """(key, chunk, start, out, shift) of ``chunks`` with their start; of fix-ups also the
    known run guess, known_out, known_shift."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i).to_pylist() for i in range(3, batch.num_columns)]
            starts = batch.column(2).to_pylist()
            made = ([fix_up(c, s, g, o, t) for c, s, g, o, t in zip(held[0], starts, *held[1:], strict=True)] if fixing
                    else [speculate(c, s) for c, s in zip(held[0], starts, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([m[0] for m in made], pa.int32()),
                 pa.array([m[1] for m in made], pa.int64())], ["key", "chunk", "start", "out", "shift"])

    names = ["key", "chunk", "start", "codes"] + (["guess", "known_out", "known_shift"] if fixing else [])
    return chunks.select(*names).mapInArrow(run, "key string, chunk long, start int, out int, shift long")


def reached(nodes: DataFrame, roots: DataFrame, step: int) -> DataFrame:
    """Those (key, chunk, at) of ``nodes`` that can be reached from ``roots`` (key, chunk, at)
    when a node leads to place ``next`` of the chunk ``step`` on."""
    jump = nodes.select("key", "chunk", "at", (F.col("chunk") + step).alias("to_chunk"), F.col("next").alias("to"))
    length = (nodes.agg(F.max("chunk")).first()[0] or 0) + 1
    found = roots.select("key", "chunk", "at")
    for _ in range(max(1, (length - 1).bit_length())):
        on = found.join(jump, ["key", "chunk", "at"]).select("key", F.col("to_chunk").alias("chunk"), F.col("to").alias("at"))
        found = store(found.union(on).distinct())
        far = jump.select("key", F.col("chunk").alias("to_chunk"), F.col("at").alias("to"),
                          F.col("to_chunk").alias("far_chunk"), F.col("to").alias("far"))
        jump = store(jump.join(far, ["key", "to_chunk", "to"]).select(
            "key", "chunk", "at", F.col("far_chunk").alias("to_chunk"), F.col("far").alias("to")))
    return found.join(nodes.select("key", "chunk", "at"), ["key", "chunk", "at"], "left_semi")


def end_vectors(chunks: DataFrame) -> DataFrame:
    """(key, chunk, start, out, shift) of every chunk with the vector at its end that holds."""
    batches_of(chunks.sparkSession, 1024)
    end = F.lit(packed(END))
    guessed = store(_run(chunks.withColumn("start", end), False))
    single = guessed.join(chunks.where("chunk = 0 AND last").select("key"), "key", "left_semi")
    known = guessed.join(chunks.where("chunk = 0 AND NOT last").select("key"), "key", "left_semi")
    base = known.select("key", "chunk", F.col("start").alias("guess"), F.col("out").alias("known_out"),
                        F.col("shift").alias("known_shift"))
    fresh = known
    if fresh.isEmpty():
        return single
    while True:
        wanted = fresh.where("chunk > 0").select("key", (F.col("chunk") - 1).alias("chunk"), F.col("out").alias("start"))
        wanted = wanted.distinct().join(known.select("key", "chunk", "start"), ["key", "chunk", "start"], "left_anti")
        fresh = store(_run(wanted.join(chunks.select("key", "chunk", "codes"), ["key", "chunk"]).join(
            base, ["key", "chunk"]), True))
        if fresh.isEmpty():
            break
        known = store(known.union(fresh))
    nodes = known.select("key", "chunk", F.col("start").alias("at"), F.col("out").alias("next"))
    roots = chunks.where("last AND chunk > 0").select("key", "chunk", end.alias("at"))
    held = reached(nodes, roots, -1).withColumnRenamed("at", "start")
    return single.union(known.join(held, ["key", "chunk", "start"]))


def _traced(chunks: DataFrame) -> DataFrame:
    """(key, chunk, at, next, edits, turns) of ``chunks`` with start and entry states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, chunk, last, codes, more, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in (range(4) if chunk else (START,)):
                    row = (key, chunk, at, *trace(codes, more, start, at, last))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                             ["key", "chunk", "at", "next", "edits", "turns"])

    return chunks.select("key", "chunk", "last", "codes", "more", "start").mapInArrow(
        run, "key string, chunk long, at int, next int, edits array<string>, turns array<string>")


def traced(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, chunk, edits, turns) of every chunk along the least audit."""
    nodes = store(_traced(chunks.join(vectors.select("key", "chunk", "start"), ["key", "chunk"])))
    first = nodes.where("chunk = 0")
    several = nodes.join(chunks.where("chunk = 0 AND NOT last").select("key"), "key", "left_semi")
    if several.isEmpty():
        return first.select("key", "chunk", "edits", "turns")
    held = reached(several, several.where("chunk = 0"), 1)
    return first.union(several.where("chunk > 0").join(held, ["key", "chunk", "at"]).select(nodes.columns)).select(
        "key", "chunk", "edits", "turns")


def _pairs(chunks: DataFrame) -> DataFrame:
    """(key, illegal): neighbours other than system-user, user-assistant, assistant-user."""
    kinds = F.transform(F.concat("codes", F.when(F.col("peek").isNotNull(), F.array("peek")).otherwise(
        F.array().cast("array<int>"))), lambda c: c.bitwiseAND(F.lit(3)))
    ok = F.array(F.lit(0 * 4 + 1), F.lit(1 * 4 + 0), F.lit(2 * 4 + 0))
    sides = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds)), lambda a, b: a * 4 + b)
    bad = F.size(F.filter(sides, lambda p: ~F.array_contains(ok, p)))
    copies = F.aggregate("more", F.lit(0).cast("long"), lambda a, b: a + b)
    return chunks.groupBy("key").agg(F.sum(bad + copies).alias("illegal"))


class Repaired:
    """A repaired table: ``rows`` (key, pos, role, text, edits, turns) in pieces of one row,
    and ``conversations`` (key, gaps, blank, duplicate, truncated, illegal, cost)."""

    def __init__(self, turns: DataFrame, size: int = SIZE, group_rows: int = GROUP_ROWS):
        rows = marked(turns, group_rows)
        chunks = chunked(rows, size)
        vectors = store(end_vectors(chunks))
        made = traced(chunks, vectors).join(chunks.select("key", "chunk", "first"), ["key", "chunk"])
        each = made.select("key", "first", F.posexplode(F.arrays_zip("edits", "turns")).alias("i", "one")).select(
            "key", (F.col("first") + F.col("i")).alias("pos"), "one.edits", "one.turns")
        # the insertions after the last row have a place of their own and no row
        self.rows = store(each.where("edits <> ''").join(rows.select("key", "pos", "role", "text"), ["key", "pos"], "left"))
        gone = F.col("code").bitwiseAND(F.lit(GONE)) != 0
        counts = rows.groupBy("key", "turn").agg(
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).when(gone, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
            F.sum((F.col("code").bitwiseAND(F.lit(CUT)) != 0).cast("long")).alias("truncated"))
        low, high = F.min("turn"), F.max("turn")
        sums = counts.groupBy("key").agg(
            F.coalesce(high - low + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        entry = F.when(F.col("chunk") == 0, F.col("out").bitwiseAND(F.lit(31))).otherwise(0)
        cost = vectors.groupBy("key").agg(F.sum(F.col("shift") + entry).alias("cost")).join(
            chunks.groupBy("key").agg(F.sum(DELETE * F.aggregate("more", F.lit(0).cast("long"), lambda a, b: a + b)).alias(
                "copies")), "key").select("key", (F.col("cost") + F.col("copies")).alias("cost"))
        self.conversations = sums.join(_pairs(chunks), "key").join(cost, "key")

    def turns(self) -> DataFrame:
        """(key, pos, i, edit, role, text): the repaired turns in order of pos and i."""
        one = F.posexplode(F.split("turns", "")).alias("i", "turn")
        role = (F.when(F.col("turn") == "K", F.col("role")).when(F.lower("turn") == "u", "user").otherwise("assistant"))
        edit = F.when(F.col("turn") == "K", "Keep").when(F.col("turn").isin("u", "a"), "Insert").otherwise("Rerole")
        return self.rows.where("turns <> ''").select("key", "pos", "role", "text", one).where("turn <> ''").select(
            "key", "pos", "i", edit.alias("edit"), role.alias("role"),
            F.when(edit == "Insert", "").otherwise(F.col("text")).alias("text"))

    def digests(self) -> DataFrame:
        """(key, audit, repaired_sha256): edits in order and a digest of the repaired text.

        Rows are sorted by conversation and read as a stream; a conversation's digest is one
        running hash, so no text is held.
        """
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, audit, digest, begun = None, [], hashlib.sha256(), False
            ready: list[tuple] = []
            for batch in batches:
                for one, edits, turns, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if one != key:
                        if key is not None:
                            ready.append((key, "".join(audit), digest.hexdigest()))
                        key, audit, digest, begun = one, [], hashlib.sha256(), False
                    audit.append(edits)
                    for turn in turns:
                        name = role if turn == "K" else "user" if turn in "uU" else "assistant"
                        body = "" if turn in "ua" else text
                        digest.update((f"\n{name}:{body}" if begun else f"{name}:{body}").encode())
                        begun = True
                if ready:
                    yield table_of(ready)
                    ready = []
            if key is not None:
                yield table_of([*ready, (key, "".join(audit), digest.hexdigest())])

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)],
                                              ["key", "audit", "repaired_sha256"])

        spark = self.rows.sparkSession
        batches_of(spark, 1024)
        return (self.rows.repartition(parts(spark), "key").sortWithinPartitions("key", "pos")
                .select("key", "edits", "turns", "role", "text")
                .mapInArrow(run, "key string, audit string, repaired_sha256 string"))


def repair(turns: DataFrame, ids: DataFrame, size: int = SIZE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each distinct conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256 of its rows in ``turns`` (conv_id, turn, role, text, any
    other columns).

    Rows stand in order of turn (null first), rows of one turn in order of role and text. A
    null role or text is one space; a null conv_id is a conversation like any other. A
    conversation without rows has zeros, an empty audit and the hash of nothing. An empty
    table of ids gives an empty one.
    """
    done = Repaired(turns, size, group_rows)
    named = ids.select("conv_id").distinct().withColumn("key", key_of("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = named.join(done.conversations, "key", "left").join(done.digests(), "key", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      text_of(F.col("audit")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
