"""Registered queries: media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .media import to_flac, to_pcm
from .registry import query


@query("op10_flac")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    read = to_pcm(to_flac(table(spark, sf, "documents")))
    joined = F.aggregate("blocks", F.lit(b""), lambda acc, b: F.concat(acc, b["pcm"]))
    back = read.select("doc_id", "n_bytes", "media", "energy", "crossings", "peak", joined.alias("payload"))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat(F.lit("energy="), "energy"), F.concat(F.lit("crossings="), "crossings"),
                    F.concat(F.lit("peak="), "peak")).alias("feature"))
