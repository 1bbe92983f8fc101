"""Registered queries: packing, sharding, chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, masked_text, read_back, to_records
from .common import table, text_of
from .packing import pack
from .registry import query
from .sharding import external_shuffle, record_bytes, shard_of

SHARDS = 40


@query("op3_sharding")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    text = text_of(F.col("text"))
    return external_shuffle(docs, SHARDS).select(
        "doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


def pieces(docs: DataFrame) -> DataFrame:
    """Pieces of the packed documents with a checksum in place of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset", "tier", "step_group")


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(table(spark, sf, "documents"))


ODD = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS name
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || name || ': ' || body || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def with_odd(turns: DataFrame) -> DataFrame:
    """The table of turns plus one conversation whose texts hold control strings."""
    odd = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").union(odd)


@query("op8_chat", CHAT_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    chats = format_chats(to_records(with_odd(table(spark, sf, "conversations"))))
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
