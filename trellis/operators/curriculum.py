"""Curriculum sampling and batching (D*).

Randomness is a pure function of ``(seed, step, slot)`` through md5, which every
engine has: a rerun, a retried task or another engine draws exactly the same
rows, and a resumed run continues with ``step > N`` (A10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.batch import dense_size, seeded_order
from trellis.operators.sequence import global_rank

#: Bits of the hash that a draw uses (13 hexadecimal digits).
_BITS = 52


def draw(seed: int, *cols) -> Column:
    """Deterministic integer in [0, 2^52) from a hash of the seed and the columns."""
    return F.conv(F.substring(seeded_order(seed, *cols), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *cols) -> Column:
    """Deterministic uniform [0, 1)."""
    return draw(seed, *cols).cast("double") / float(1 << _BITS)


def mix_ratio(step, max_steps: int | None) -> Column:
    """``min(0.5, step / max_steps * 0.5)``; ``max_steps=None`` → 10000."""
    denom = float(max_steps if max_steps is not None else 10000)
    s = step if isinstance(step, Column) else F.col(step)
    return F.least(F.lit(0.5), s.cast("double") / denom * 0.5)


def epoch_length(main: DataFrame, extra: DataFrame | None) -> DataFrame:
    """D3: ``max(len(main), len(extra))`` as a one-row table: one aggregate over
    both sets."""
    flag = main.select(F.lit(1).alias("m"), F.lit(0).alias("e"))
    if extra is not None:
        flag = flag.unionByName(extra.select(F.lit(0).alias("m"), F.lit(1).alias("e")))
    n = flag.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"))
    return n.select(F.greatest("m", "e").cast("long").alias("epoch_length"))


def total_steps(main: DataFrame, batch_size: int, episodes: int, max_steps: int | None = None,
                drop_last: bool = True) -> DataFrame:
    """``max_steps`` or batches per epoch × episodes, as a one-row table
    ``(n_rows, batches_per_epoch, total_steps)``."""
    n = main.agg(F.count(F.lit(1)).alias("n_rows"))
    per = F.col("n_rows") / batch_size
    per = (F.floor(per) if drop_last else F.ceil(per)).cast("long")
    steps = per * episodes if max_steps is None else F.lit(max_steps)
    return n.select("n_rows", per.alias("batches_per_epoch"), steps.cast("long").alias("total_steps"))


def curriculum_mix(spark: SparkSession, main: DataFrame, extra: DataFrame | None, steps: int, batch_size: int,
                   max_steps: int | None, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """For each (step, slot) draw the source — the extra set with
    probability ``mix_ratio(step)`` — then a row of that source uniformly
    **with replacement** (the requested index is ignored).  Both sources must
    number their rows 0..n-1 in ``id_col`` (checked: a gap would lose draws).
    Returns ``(step, slot, source, pick)`` joined to the picked rows' columns."""
    n_main = dense_size(main, id_col)
    n_extra = dense_size(extra, id_col) if extra is not None else 0
    if not n_main or extra is not None and not n_extra:
        raise ValueError("a source to draw from is empty")
    slots = spark.range(steps * batch_size).select(
        (F.col("id") / batch_size).cast("long").alias("step"), (F.col("id") % batch_size).alias("slot"))
    drawn = draws(slots, n_main, n_extra, max_steps, seed)
    m = main.withColumn("source", F.lit("main")).withColumnRenamed(id_col, "pick")
    parts = [drawn.filter(F.col("source") == "main").join(m, ["source", "pick"])]
    if extra is not None:
        e = extra.withColumn("source", F.lit("extra")).withColumnRenamed(id_col, "pick")
        parts.append(drawn.filter(F.col("source") == "extra").join(e, ["source", "pick"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def draws(slots: DataFrame, n_main: int, n_extra: int, max_steps: int | None, seed: int) -> DataFrame:
    """Source and row of each ``(step, slot)``; batch and stream share it."""
    key = (F.col("step"), F.col("slot"))
    ratio = mix_ratio(F.col("step"), max_steps) if n_extra else F.lit(0.0)
    source = F.when(uniform(seed, *key, "source") < ratio, F.lit("extra")).otherwise(F.lit("main"))
    index = draw(seed, *key, "index")
    pick = F.when(F.col("source") == "extra", index % max(n_extra, 1)).otherwise(index % n_main)
    return slots.withColumn("source", source).withColumn("pick", pick)


def batches(df: DataFrame, batch_size: int, seed: int | None = None, epoch: int = 0,
            drop_last: bool = True, id_col: str = "row_id") -> DataFrame:
    """``batch_id = rank div batch_size``; rank by ``md5(seed:epoch:id)``
    (shuffled) or by id (sequential); a trailing short batch is dropped when
    ``drop_last``.  Ranks are dense whatever gaps the ids have."""
    if seed is None:
        r = global_rank(df, [id_col], "_rank")
    else:
        h = df.withColumn("_h", seeded_order(seed, epoch, F.col(id_col)))
        r = global_rank(h, ["_h", id_col], "_rank").drop("_h")
    out = r.withColumn("batch_id", (F.col("_rank") / batch_size).cast("long"))
    if drop_last:
        out = out.filter(F.col("batch_id") < df.count() // batch_size)
    return out.withColumnRenamed("_rank", "position")


def resume_feed(fed: DataFrame, last_step: int, step: str = "step") -> DataFrame:
    """A10: resuming after ``global_step_N`` is a filter on the pure feed."""
    return fed.filter(F.col(step) > last_step)
