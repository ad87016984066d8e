"""Ordered numbering without single-key windows.

``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task,
so a key holding a third of the data becomes one straggler. The helpers here
range-partition on ``(keys, order)`` — a hot key is then spread over many
partitions — number the rows inside each sorted partition in the JVM, and add
the sizes of what lies before.

The numbered rows are written once to the shared folder and every later step
reads that table. Range partitioning samples its boundaries, so two evaluations
of the same plan may cut differently (as soon as column pruning makes them two
plans); row positions and partition sizes must come from one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import scratch_table

_MID, _PID, _LR, _CNT, _OFF = "_trellis_mid", "_trellis_pid", "_trellis_lr", "_trellis_cnt", "_trellis_off"
#: ``monotonically_increasing_id`` holds the partition above these bits.
_BITS = 33


def _num_partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sorted_once(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """``df`` cut and sorted by ``order``, with each row's partition and its
    place in it, as a written table."""
    cut = df.repartitionByRange(_num_partitions(df, n), *order).sortWithinPartitions(*order)
    table = scratch_table(cut.withColumn(_MID, F.monotonically_increasing_id()), "sorted")
    return (table.withColumn(_PID, F.shiftright(_MID, _BITS))
            .withColumn(_LR, F.col(_MID).bitwiseAND(F.lit((1 << _BITS) - 1))).drop(_MID))


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Key equality in which nulls are one key."""
    cond = F.col(f"{a}.{_PID}") == F.col(f"{b}.{_PID}")
    for k in keys:
        cond = cond & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return cond


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
           num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based row number of each row within ``keys`` by ``order``
    (``row_number() over (partition by keys order by order) - 1``; rows with a
    null key form one group). ``order`` must be total within a key.

    The window below groups by ``(partition, keys)``, so no task holds more of a
    key than one range partition does."""
    keys, order = list(keys), list(order)
    table = _sorted_once(df, [*keys, *order], num_partitions)
    local = table.withColumn(_LR, F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(_LR)) - 1)
    parts = table.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias(_CNT))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # a key that goes on from an earlier partition: at most one per partition
    offsets = parts.withColumn(_OFF, F.sum(_CNT).over(before)).where(F.col(_OFF).isNotNull())
    joined = local.alias("l").join(F.broadcast(offsets).alias("o"), _same("l", "o", keys), "left")
    position = (F.col(f"l.{_LR}") + F.coalesce(F.col(f"o.{_OFF}"), F.lit(0))).cast("long")
    return joined.select(*[F.col(f"l.`{c}`").alias(c) for c in df.columns], position.alias(out))


def global_rank(df: DataFrame, order: Sequence[str], out: str = "rn",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order`` (a distributed
    ``zipWithIndex``): place in the sorted partition plus the sizes of the
    partitions before, one row each."""
    table = _sorted_once(df, list(order), num_partitions)
    sizes = table.groupBy(_PID).agg(F.count(F.lit(1)).alias(_CNT))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PID, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    joined = table.join(F.broadcast(offsets), _PID)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(_LR) + F.col(_OFF)).cast("long").alias(out))


def running_sum(df: DataFrame, order: Sequence[str], weight: str, out: str = "start",
                num_partitions: int | None = None) -> DataFrame:
    """Sum of ``weight`` over all rows before each row in the total order
    ``order``: the sum inside the sorted partition plus the partitions before."""
    table = _sorted_once(df, list(order), num_partitions)
    inside = Window.partitionBy(_PID).orderBy(_LR).rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(_PID).agg(F.sum(weight).alias(_CNT))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_PID, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    joined = table.withColumn(_LR, F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(offsets), _PID)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(_LR) + F.col(_OFF)).alias(out))
