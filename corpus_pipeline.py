"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; between stages the rows are written as Parquet and read again. Stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.llm.common import release, store, table
from flowgrain.llm.decontaminate import decontaminate
from flowgrain.llm.nearcopies import one_of_each_group
from flowgrain.llm.pii import sanitise
from flowgrain.llm.queries_layout import pieces
from flowgrain.llm.toxicity import drop

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; learned from all labels.

    Null and empty texts have no votes; rows equal in doc_id and text stay or go together. A
    null doc_id has no label but is scored. An empty table stays empty.
    """
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return drop(docs, labels, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more, found by
    SimHash fingerprints in tiles and decided exactly): that of the least doc_id, null last. Texts without words are one group, repeated rows one row. An
    empty table stays empty.
    """
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts hold none and stay.
    Repeated rows stay or go together. Without items all rows stay.
    """
    return decontaminate(docs, table(spark, sf, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced; ``n_chars``, where
    there is one, is counted again. All rows stay, repeated ones too; null and empty texts
    hold no personal data. An empty table stays empty.
    """
    clean = sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Pieces of packed sequences; null and empty texts are one end token. An empty table gives
    no pieces.
    """
    return pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: The scores, fingerprints and token ids of the stages are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf: str) -> DataFrame:
    """All stages, applied to the documents of a data folder."""
    docs = table(spark, sf, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        kept = store(stage(spark, docs, sf))
        if n:
            release(docs)  # what a stage kept is read by the next one only
        docs = kept
    return STAGES[-1][1](spark, docs, sf)
