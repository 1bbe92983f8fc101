"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain import session

__all__ = ["batches_of", "parts", "release", "shielded", "store", "table", "text_of", "texts"]

#: Rows of one Arrow batch sent to a Python worker; whole texts can be long.
BATCH_ROWS = 256
#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = "8m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches of this session small, so that workers hold few long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that lost executors
    cost no earlier step, and let go of the shuffle files behind it.

    Spark deletes shuffle files once the driver's garbage collector finds their plans
    unused, which can be long after; a large job would pile up all its shuffles until then.
    """
    spark = df.sparkSession
    folder = f"{session.shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    kept = spark.read.schema(df.schema).parquet(folder)
    kept.stored_at = folder
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``store`` that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shielded(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with all columns but ``keep`` under names that no operator uses; give the old
    names back with ``toDF``."""
    return df.toDF(*[c if c in keep else f"c{i}" for i, c in enumerate(df.columns)])


def text_of(column: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], id_name: str, text_name: str) -> Iterator[tuple[object, bytes]]:
    """(id, UTF-8 text) of every row of a stream of batches."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_name)).to_pylist()
        yield from zip(ids, texts(batch, text_name), strict=True)
