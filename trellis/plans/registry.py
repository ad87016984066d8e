"""Query catalog: name → Spark job ``(spark, sf_dir) -> DataFrame`` and, where
the result is expressible in SQL, the DuckDB statement that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for cross-engine comparison (``round(x, 6) + 0.0``
    also turns -0.0 into 0.0)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
