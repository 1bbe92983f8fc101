"""Shuffled shards by a two-pass external shuffle.

Method. Pass one scatters records over memory-sized buckets by seeded hashes: the shard by
the highest of one hash for each shard (so one more shard takes rows only into itself), and
the bucket inside the shard by a hash of the whole record. Pass two loads one bucket at a
time, shuffles it by Fisher-Yates and gives its rows consecutive slots of their shard.
Since every bucket is a uniform part of its shard, the buckets in line are a uniform
shuffle of the shard.

Size. The number of buckets of a shard follows its measured bytes, so a bucket stays near
``bucket`` bytes at any scale; only one is in memory at a time. A doc_id that many rows share
still spreads over the buckets of its shard; rows equal in every column that would fill a
good part of a bucket are counted, kept once, and numbered when they are copied out. Rows are put in a fixed order before the shuffle of
a bucket, so a task that runs again gives the same slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrain.scale import lookup

from .common import store, text_of

#: Bytes of a bucket, and bytes of a record besides its text.
BUCKET, RECORD = 32 << 20, 16
SEED = 7


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed part."""
    return (F.octet_length(text_of(text)) + RECORD).cast("long")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard by highest seeded hash. A null key is one more value."""
    base = F.coalesce(F.xxhash64(key, F.lit(seed)), F.lit(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                                   lambda s: F.struct(F.xxhash64(base, s).alias("h"), s.alias("s"))))
    return best["s"].cast("int")


def _fisher_yates(seed: int, schema: T.StructType):
    def run(key, rows: pa.Table, base: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        order = np.lexsort([rows.column(n).to_numpy() for n in ("__number", "__content", "__order")])
        shard, bucket = (k.as_py() for k in key)
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # an in-place Fisher-Yates
        slots = np.arange(rows.num_rows, dtype=np.int64) + (base.column("__base")[0].as_py() if rows.num_rows else 0)
        out = rows.select([n for n in schema.names if n != "slot"]).take(pa.array(order))
        return out.append_column("slot", pa.array(slots)).select(schema.names)
    return run


def external_shuffle(records: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                     bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``records`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    All columns are kept; columns already named shard or slot are replaced. Null keys share
    a shard; rows with equal keys share one, in different slots. The order of rows equal in
    every column among each other has no meaning. An empty table gives an empty one.
    """
    kept = records.drop("shard", "slot")
    names = kept.columns
    inner = [f"c{i}" for i in range(len(names))]  # names that no column of the caller can clash with
    plain = kept.toDF(*inner)
    at = lambda name: F.col(inner[names.index(name)])
    marked = (plain.withColumn("__content", F.xxhash64(*inner)).withColumn("shard", shard_of(at(key), shards, seed)))
    copies = marked.groupBy("shard", "__content").agg(F.count("*").alias("n"), F.max(record_bytes(at(text))).alias("size"))
    copies = store(copies)
    # one row for each shard: at most ``shards`` rows
    cuts = copies.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") * F.col("size")) / bucket)).alias("__cuts"))
    # rows whose equals would fill a good part of a bucket are told apart by a number
    many = copies.where((F.col("n") > 1) & (F.col("n") * F.col("size") > bucket // 8)).select(
        "shard", "__content", F.col("n").alias("__many"))
    marked = lookup(marked.join(F.broadcast(cuts), "shard"), many, ["shard", "__content"])
    number = F.explode(F.sequence(F.lit(1), F.col("__many"))).alias("__number")
    single = marked.where("__many IS NULL").withColumn("__number", F.lit(0).cast("long"))
    equal = marked.where("__many IS NOT NULL").dropDuplicates(["shard", "__content"]).select("*", number)
    marked = (single.union(equal).withColumn("__order", F.xxhash64(F.col("__content"), F.lit("order")))
              .withColumn("__bucket", F.pmod(F.xxhash64("__content", "__number", F.lit(seed)), F.col("__cuts")))
              .drop("__cuts", "__many"))
    sizes = marked.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")))
    schema = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.LongType())])
    return (marked.groupBy("shard", "__bucket").cogroup(bases.groupBy("shard", "__bucket"))
            .applyInArrow(_fisher_yates(seed, schema), schema).toDF(*names, "shard", "slot"))


def write_shards(records: DataFrame, folder: str, shards: int, **options) -> None:
    """Write the shuffled records as Parquet, one folder for each shard, in slot order
    within files; a file covers a range of slots."""
    out = external_shuffle(records, shards, **options)
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))
