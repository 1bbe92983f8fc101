"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nudge(digits: int) -> float:
    """Moves exact decimal halves off the rounding border, where engines disagree."""
    return 3.7 * 10.0 ** -(digits + 4)


def rounded(df: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """Round floating-point columns: summation order differs between engines.

    ``others`` gives single columns their own digits; a negative number leaves one as is.
    """
    for f in df.schema.fields:
        n = others.get(f.name, digits)
        if f.dataType.typeName() in ("double", "float") and n >= 0:
            # adding 0 turns a negative zero into a plain one
            df = df.withColumn(f.name, F.round(F.col(f.name) + F.lit(nudge(n)), n) + F.lit(0.0))
    return df


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL text of one rounded output column."""
    return f"round(({expr}) + {nudge(digits):.17g}::DOUBLE, {digits}) + 0 AS {name}"

