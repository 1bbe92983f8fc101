"""Skew-safe building blocks shared by the operators.

One key may hold a third of all rows, so nothing here sends a whole group to one
task: groups are ranked over range partitions, lookups are salted once the small
side outgrows a checked bound, and group statistics are partial aggregates joined
back over (key, salt).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import pin

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
GROUP_ROWS = 1_000_000
SALTS = 16


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size; variable-width columns are measured."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(8)
        elif "<" in kind:
            text = F.to_json(F.struct(f.name))
            total = total + F.lit(2) * F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)
        else:
            total = total + F.lit(16)
    return total


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``rows`` rows of at most ``size`` bytes together.

    No more than ``rows`` rows are read; they are counted and measured, not estimated.
    """
    n, width = df.limit(rows + 1).agg(F.count(F.lit(1)),
                                      F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return n <= rows and width <= size


def salt_of(df: DataFrame, salts: int = SALTS, keys: Sequence[str] = ()) -> Column:
    """Salt from the row's exact columns: a retried task must repeat it, and the last
    digits of a recomputed floating-point sum may not. Plain columns are preferred, so
    wide arrays are neither read nor hashed for it."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    usable = [n for n, k in kinds.items() if "map<" not in k]
    exact = [n for n in usable if "double" not in kinds[n] and "float" not in kinds[n]]
    plain = [n for n in exact if "<" not in kinds[n]]
    for names in (plain, exact):
        if set(names) - set(keys):
            return F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")
    return F.pmod(F.xxhash64(*usable), F.lit(salts)).cast("int")


def per_salt(dim: DataFrame, salts: int = SALTS) -> DataFrame:
    return dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``on`` columns where NULL equals NULL, as in grouping."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(other, match, how).drop(*[f"_same_{k}" for k in on])


def salted_join(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
                salts: int = SALTS, nulls_match: bool = False) -> DataFrame:
    """Equi-join whose big side spreads every key over ``salts`` tasks.

    Rows should carry an id so that copies of one row spread too. ``dim`` is replicated
    per salt and must hold few rows per key. ``nulls_match`` is for a ``dim`` grouped by
    the same keys, whose NULL group belongs to the NULL rows.
    """
    left = big.withColumn("_salt", salt_of(big, salts, on))
    right = per_salt(dim, salts)
    out = (same_keys(left, right, [*on, "_salt"], how) if nulls_match
           else left.join(right, [*on, "_salt"], how))
    return out.drop("_salt")


def lookup(big: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "left",
           rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach ``dim`` columns: broadcast while ``dim`` is provably small, salted beyond.

    ``dim`` is counted first, so it should be a stored table or cheap to recompute; an
    aggregate of a feed belongs in ``salted_join``, where AQE sees its size at run time.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits(dim, rows):
        return big.join(F.broadcast(dim), on, how)
    return salted_join(big, dim, on, how)


def group_join(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row without gathering the group in one task."""
    dim = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return salted_join(df, dim, keys, nulls_match=True)


def scalar_join(df: DataFrame, aggs: Mapping[str, Column], source: DataFrame | None = None
                ) -> DataFrame:
    """Add whole-table aggregates: one row, broadcast over a constant key."""
    one = (source if source is not None else df).agg(*[c.alias(n) for n, c in aggs.items()])
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pos: str = "pos",
           sums: Mapping[str, str] | None = None, total: str | None = None,
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """1-based position (and running sums) inside each ``keys`` group.

    ``order`` must be total inside a group. Groups up to ``group_rows`` use a plain
    window. Beyond, rows are range partitioned over (keys, order), so a hot group
    spans many partitions; each is ranked alone and shifted by what the earlier ones
    hold. Offsets have one row per (key, partition) and stay small.
    """
    sums = dict(sums or {})
    keys = list(keys)
    if keys and largest_group(df, keys) <= group_rows:
        w = Window.partitionBy(*keys)
        run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(pos, F.row_number().over(w.orderBy(*order)).cast("long"))
        for name, src in sums.items():
            out = out.withColumn(name, F.sum(src).over(run))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out

    ranged = pin(df.repartitionByRange(*[F.col(k) for k in keys], *order)
                 .withColumn("_part", F.spark_partition_id()))
    held = ranged.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_s_{n}") for n, s in sums.items()])
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *keys, "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *([F.sum("_n").over(by).alias(total)] if total else []))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_local", F.row_number().over(local))
    for name, src in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(src).over(run), F.lit(0)))
    out = same_keys(out, offsets, [*keys, "_part"])
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_b_{name}"))
    return (out.withColumn(pos, (F.col("_local") + F.col("_before")).cast("long"))
            .drop("_part", "_local", "_before", *[f"_b_{n}" for n in sums]))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
           lags: Mapping[str, tuple[str, int]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """``lag`` per group: {new column: (source column, steps)}.

    Long groups are cut into chunks of ``group_rows`` positions; the last rows of a
    chunk are copied into the next one so its first rows find their predecessors.
    """
    keys = list(keys)
    if keys and largest_group(df, keys) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        for name, (src, steps) in lags.items():
            df = df.withColumn(name, F.lag(src, steps).over(w))
        return df
    reach = max(steps for _, steps in lags.values())
    size = max(group_rows, reach)
    out = ranked(df, keys, order, "_pos", group_rows=group_rows)
    chunk, inside = F.floor((F.col("_pos") - 1) / size), (F.col("_pos") - 1) % size
    out = (out.withColumn("_home", chunk)
           .withColumn("_chunk", F.explode(F.when(inside >= size - reach,
                                                  F.array(chunk, chunk + 1))
                                           .otherwise(F.array(chunk)))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    for name, (src, steps) in lags.items():
        out = out.withColumn(name, F.lag(src, steps).over(w))
    return (out.where(F.col("_home") == F.col("_chunk"))
            .drop("_pos", "_home", "_chunk"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``probs``.

    Small groups use the built-in aggregate. Large ones are ranked over range
    partitions and only the rows at the two positions around each rank are kept.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if largest_group(rows, keys) <= group_rows:
        return rows.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(float(p))).alias(n) for n, p in probs.items()])
    # equal values are merged first, so copies of one value never pile up in one partition
    tally = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = ranked(tally, keys, [F.col("_v")], "_pos", sums={"_hi": "_c"}, group_rows=group_rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    run = (salted_join(run, sizes, keys, nulls_match=True) if keys
           else scalar_join(run, {"_n": F.count(F.lit(1))}, rows))
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1) + 1
        low, high = F.floor(at), F.ceil(at)
        lo_col = F.max(F.when((F.col("_hi") - F.col("_c") < low) & (low <= F.col("_hi")),
                              F.col("_v")))
        hi_col = F.max(F.when((F.col("_hi") - F.col("_c") < high) & (high <= F.col("_hi")),
                              F.col("_v")))
        out.append((lo_col + (hi_col - lo_col) * F.max(at - low)).alias(name))
    return run.groupBy(*keys).agg(*out)
