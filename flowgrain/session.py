"""Session settings the library depends on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and the session is
    local; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="flowgrain-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For tables many jobs scan: unlike ``pin`` it keeps column pruning, filter pushdown
    and a file size the optimizer can trust. ``pin`` keeps the partitioning instead.
    """
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """Write ``df`` once as a table bucketed by ``key``; joins and groupings on it inside
    the block read the buckets in place instead of shuffling the table again.

    The catalog entry goes away at the end, so results must be written by then.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"flowgrain_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def utc(spark: SparkSession) -> SparkSession:
    """Feed times are local clock readings without a zone; UTC keeps them unshifted."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
