"""Registered queries: ids of texts, whitened vectors, repaired conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import decode_pieces, encode_pieces
from .registry import query
from .repair import repair
from .whitening import whiten


@query("op11_pieces")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    read = decode_pieces(encode_pieces(table(spark, sf, "documents")))
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults by a checksum of conversation and turn: dropped, emptied, without
    stops, repeated, or given to the user."""
    plain = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return plain.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("copy")).drop("copy")


@query("op13_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return repair(damaged(turns), turns)
