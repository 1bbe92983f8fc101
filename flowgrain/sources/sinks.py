"""Writers. Each makes one pass; partitions are folders, never one scan per value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import stages

C = F.col


def write_days(df: DataFrame, folder: str, day: str = "dt") -> None:
    """One folder per day. Rebalancing splits a busy day and merges quiet ones by size."""
    df.hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(folder)


def write_years(df: DataFrame, folder: str, day: str = "dt") -> None:
    """One folder per year."""
    (df.withColumn("year", F.year(day)).hint("rebalance", "year")
     .write.mode("overwrite").partitionBy("year").parquet(folder))


def write_table(df: DataFrame, folder: str, decimals: int = 3, sep: str = ",") -> None:
    """CSV with a header and fixed decimals for floating-point columns."""
    cols = [F.format_string(f"%.{decimals}f", C(f.name)).alias(f.name)
            if f.dataType.typeName() in ("double", "float") else C(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", sep).csv(folder)


def report(spark: SparkSession, options: Mapping[str, object], **tables: DataFrame) -> DataFrame:
    """Rows (option, value): given settings, then the row count of each table."""
    rows = spark.createDataFrame([(k, str(v)) for k, v in options.items()],
                                 "option string, value string")
    for name, df in tables.items():
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).cast("string").alias("value"))
                                .select(F.lit(name).alias("option"), "value"))
    return rows


def write_replicate(df: DataFrame, folder: str, rep: int) -> None:
    """Append the results of one replicate under its own partition."""
    (df.withColumn("rep", F.lit(rep)).write.mode("append").partitionBy("rep").parquet(folder))


def cumulative_replicates(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    return spark.read.parquet(folder).where(C("rep") <= upto)


def inference_table(norefined: DataFrame, refined: DataFrame) -> DataFrame:
    return stages(norefined=norefined, refined=refined)


def write_paths(paths: DataFrame, folder: str, sep: str = ",") -> None:
    (paths.select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), sep)
                  .alias("value")).write.mode("overwrite").text(folder))


def write_network(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite",
                  by: str | None = None) -> None:
    """Network tables as Parquet folders, optionally partitioned by network."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{folder}/{name}")


def demand_rows(od: DataFrame) -> DataFrame:
    """Rows of the demand text file: 1-based ids, pairs within one zone left out."""
    return od.where(C("o") != C("d")).select((C("o") + 1).alias("origin"),
                                             (C("d") + 1).alias("dest"), C("q").alias("demand"))


def link_rows(links: DataFrame) -> DataFrame:
    return links.select((C("u") + 1).alias("origin"), (C("v") + 1).alias("dest"),
                        C("k").alias("capacity"), C("tf").alias("length"), C("tf").alias("fft"),
                        "alpha", "beta", F.lit(0).alias("speedLimit"))


def write_dat(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(folder)


def tntp_trip_lines(od: DataFrame) -> DataFrame:
    """One ``Origin`` block per demand row, so no origin is gathered in one task."""
    return od.select(F.format_string("Origin \t%d \n%5d : %s;\n", C("o").cast("int"),
                                     C("d").cast("int"), C("q").cast("string")).alias("value"))


def tntp_link_lines(links: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Data lines of a link table, 1-based ids, tab separated with a closing semicolon."""
    cells = [(C("u") + 1).cast("string"), (C("v") + 1).cast("string"),
             *[C(c).cast("string") for c in columns]]
    line = F.concat(F.lit("\t"), F.concat_ws("\t", *cells), F.lit("\t;"))
    return links.select(*keep, line.alias("value"))


def feature_layer(links: DataFrame, features: DataFrame, on: Sequence[str] = ("u", "v")
                  ) -> DataFrame:
    """Link features with line geometry as text."""
    from ..operators.spatial import as_line_text
    return as_line_text(links.select(*on, "x1", "y1", "x2", "y2").join(features, list(on))
                        ).drop("x1", "y1", "x2", "y2")
