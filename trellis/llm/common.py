"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import run_folder, ship_package

#: Space, tab, line feed, vertical tab, form feed, carriage return: the only
#: word separators of the white-space tokenisation. ``bytes.split()`` splits on
#: exactly these.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: For ``bytes.translate``: A-Z to a-z, every ASCII byte outside 0-9a-z to a
#: space. Bytes of non-ASCII characters stay, so UTF-8 sequences stay whole.
ALNUM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which all machines share."""
    return f"{run_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage is
    cut, any executor may be lost later, and each later reader sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` refers to
    it inside a lambda (a plain reference would be evaluated per element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def white_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as an array; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), "")


def small_enough(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows (one count job)."""
    return df.count() <= bound


def join_checked(left: DataFrame, right: DataFrame, on, how: str, bound: int = 100_000) -> DataFrame:
    """Join with ``right`` broadcast only when it was counted to have at most
    ``bound`` rows; else an ordinary join, whose hot keys AQE splits."""
    return left.join(F.broadcast(right) if small_enough(right, bound) else right, on, how)


def with_row(df: DataFrame, rest: str) -> T.StructType:
    """Schema of the column ``row`` of ``df`` and the columns in ``rest`` (DDL)."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(rest).fields])


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with the package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
