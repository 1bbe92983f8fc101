"""Registered queries: personal data, toxicity, quality, decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import table
from .decontaminate import mark
from .pii import KINDS, detect
from .pii_sql import PII_SQL
from .registry import query


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op2_pii", PII_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = detect(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[_number(k) for k in KINDS],
                        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
                        _joined(F.concat("base_spans", "term_spans")).alias("spans"))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", "m.start", "m.length", "m.edits")


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def judged(scored: DataFrame, held_out: Column) -> DataFrame:
    """A score as the contract of the two classifiers has it."""
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder(3) == 1
    labels = table(spark, sf, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    return judged(toxicity.fit_and_score(table(spark, sf, "documents"), labels), held_out)


@query("op1_quality")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder(4) == 2
    labels = table(spark, sf, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    return judged(quality.score(table(spark, sf, "documents"), labels), held_out)
