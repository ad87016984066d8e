"""Mixing sources to target weights by capped water-filling. DataFrame functions
only.

Every source has a size (its words), a weight and a cap (``max_epochs`` times its
size). The total size is shared out by weight; a source that would exceed its cap
is clamped there and the excess is shared again by weight among the others, until
none exceeds. That process ends at one water level: with sources ordered by
cap / weight, the clamped ones are a prefix, and the level after clamping k of
them is (total - their caps) / (weight of the rest). So one ordered pass over the
source table finds it; the table has one row per source, pre-aggregated.

A source's target is then met by whole and fractional repetitions: each document
is taken floor(target / size) times, and documents in a seeded random order are
taken once more until the rest of the target is reached. The order is never
materialised for a whole source: sizes are summed per bucket of the seeded hash,
buckets are accumulated, and only the one bucket in which the target falls is
ordered row by row.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; sources without words get target 0 and nothing is taken; equal rows
are interchangeable, and each gets a row; an empty table gives an empty table;
extra columns are kept by :func:`mix` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import join_checked, shared_table, white_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Buckets of the seeded order per source.
BUCKETS = 4096


def cyclic_weights(weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Weights dealt in turn to the sources by code point, null last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight > 0) to the same with ``target``. One row per source."""
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = (F.col("source_size") * F.lit(max_epochs)).cast("double")
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    ranked = (sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("level", level))
    # the first source whose ratio is not below its level sets the water level
    water = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    return (ranked.withColumn("water", water)
            .withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
            .select("source", "source_size", "weight", "target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS,
        max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to (row: all its columns, size,
    source_size, target, repeats: how often the mix takes the document)."""
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))
    number = F.conv(F.substring(order, 1, 13), 16, 10).cast("long")  # 52 bits
    sized = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"),
                        F.size(white_words(F.col("text"))).cast("long").alias("size"), number.alias("order"))
    return _taken(sized, weights, max_epochs)


def _taken(sized: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    bucket = F.shiftright("order", 52 - BUCKETS.bit_length() + 1)
    parts = shared_table(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "bucket-sizes")
    sources = parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")).withColumn("weight", cyclic_weights(weights))
    targets = shared_table(
        water_fill(sources, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("t.source").eqNullSafe(F.col("p.source"))
    edge = (parts.withColumn("before", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)))
            .alias("p").join(targets.alias("t"), same)
            .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") >= F.col("rest")))
            .groupBy(F.col("p.source").alias("source")).agg(F.min(F.struct("bucket", "before")).alias("edge")))
    plan = targets.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select(
        "t.source", "source_size", "target", "whole", "rest", "edge")
    plan = shared_table(plan, "mix-plan")
    found = join_checked(sized.alias("d"), plan.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "inner").select(
        "row", "size", "order", F.col("d.source").alias("source"), "source_size", "target", "whole", "rest", "edge",
        bucket.alias("bucket"))
    # the bucket in which the target falls is ordered row by row; the others need no order
    at_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    inner = Window.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    edged = found.where(at_edge).withColumn("start", F.col("edge.before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edged = edged.withColumn("more", F.col("start") + F.col("size") / 2 <= F.col("rest"))
    others = found.where(~at_edge).withColumn(
        "more", F.coalesce(F.col("bucket") < F.col("edge.bucket"), F.lit(False)))
    out = others.unionByName(edged.drop("start"))
    return out.select("row", "size", "source_size", "target",
                      (F.col("whole") + F.col("more").cast("long")).alias("repeats"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document's columns, one row per repetition."""
    return mixed.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("n")).select("row.*")
