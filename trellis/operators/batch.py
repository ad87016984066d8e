"""Aligned-batch algebra (B*): a batch is a DataFrame with a dense ``row_id``.

Row identity is explicit (DataFrames are unordered).  Operators that need the
batch size run one aggregate, which also proves that the ids are 0..n-1
(:func:`dense_size`: a gap would silently lose or misplace rows); every
row-level step is a narrow expression, an ``explode`` or an equi-join.

Batch constants (``meta``: one value per batch, not per row) travel with
:class:`Batch`, a pair of rows and constants.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from trellis.session import scratch_path, ship_package
from trellis.operators.sequence import global_rank

ROW_ID = "row_id"


def from_dict(spark: SparkSession, data: dict, schema: Ty.StructType | None = None) -> DataFrame:
    """B1: columns of equal length → DataFrame with ``row_id`` (non-empty)."""
    lengths = {k: len(v) for k, v in data.items()}
    if not lengths or len(set(lengths.values())) != 1 or next(iter(lengths.values())) == 0:
        raise ValueError(f"columns must be non-empty and of equal length: {lengths}")
    names = list(data)
    n = next(iter(lengths.values()))
    rows = [tuple([i] + [data[k][i] for k in names]) for i in range(n)]
    if schema is None:
        return spark.createDataFrame(rows, [ROW_ID, *names])
    full = Ty.StructType([Ty.StructField(ROW_ID, Ty.LongType(), False), *schema.fields])
    return spark.createDataFrame(rows, full)


def assign_row_ids(df: DataFrame, order: Sequence[str], out: str = ROW_ID) -> DataFrame:
    """Dense 0-based ids in the total order ``order`` (distributed)."""
    return global_rank(df, order, out)


def dense_size(df: DataFrame, id_col: str = ROW_ID) -> int:
    """Number of rows; raises unless the ids are exactly 0..n-1 (each once).
    Ids set the bits of a bitmap per 32,768 ids, so repeats show as fewer bits than
    rows: exact for any ids. A task passes on one bitmap (4 KB) for each range of ids
    it has met; ids that stand in their order, as numbering writes them, are about a
    bit each."""
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    per = ids.groupBy(F.bitmap_bucket_number("i").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count("i").alias("k"), F.min("i").alias("lo"), F.max("i").alias("hi"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.coalesce("i", F.lit(0))))).alias("bits"))
    r = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                F.sum("bits").alias("bits")).first()
    n = r.n
    if n and (r.k, r.lo, r.hi, r.bits) != (n, 0, n - 1, n):
        raise ValueError(f"{id_col} must number the {n} rows 0..{n - 1} without gaps or repeats")
    return n


def check_consistency(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """B2: rows whose array columns differ in length (empty when consistent)."""
    first = F.size(arrays[0])
    bad = F.lit(False)
    for a in arrays[1:]:
        bad = bad | (F.size(a) != first)
    return df.filter(bad)


def assert_consistent(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """B2 as an in-plan assertion: raises while the plan runs."""
    first = F.size(arrays[0])
    cond = F.lit(True)
    for a in arrays[1:]:
        cond = cond & (F.size(a) == first)
    return df.withColumn("_ok", F.when(cond, F.lit(True)).otherwise(
        F.raise_error(F.lit("array columns differ in length")))).filter(F.col("_ok")).drop("_ok")


def select(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Projection; ``None`` keeps every column (the id is always kept)."""
    if keys is None:
        return df
    return df.select(ROW_ID, *[k for k in keys if k != ROW_ID])


def pop(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into (taken, rest); both keep ``row_id``."""
    return select(df, keys), df.drop(*[k for k in keys if k != ROW_ID])


def merge_meta(*parts: dict) -> dict:
    """All constants; a name with two different values raises."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if k in out and out[k] != v:
                raise ValueError(f"batch constant {k!r} has two values: {out[k]!r} and {v!r}")
            out[k] = v
    return out


@dataclass(frozen=True)
class Batch:
    """Aligned rows and the batch's constants."""

    rows: DataFrame
    meta: dict = field(default_factory=dict)

    def select(self, keys: Sequence[str] | None = None, meta_keys: Sequence[str] | None = None) -> Batch:
        """Columns and constants by name (None: all)."""
        return Batch(select(self.rows, keys), dict(self.meta) if meta_keys is None else {k: self.meta[k] for k in meta_keys})

    def pop(self, keys: Sequence[str], meta_keys: Sequence[str] = ()) -> tuple[Batch, Batch]:
        """(taken, rest)."""
        taken, rest = pop(self.rows, keys)
        return (Batch(taken, {k: self.meta[k] for k in meta_keys}),
                Batch(rest, {k: v for k, v in self.meta.items() if k not in meta_keys}))

    def union(self, other: Batch) -> Batch:
        """Shared columns and shared constants must agree."""
        return Batch(union(self.rows, other.rows), merge_meta(self.meta, other.meta))

    @staticmethod
    def concat(parts: Sequence[Batch]) -> Batch:
        """Rows after each other; constants must agree."""
        return Batch(concat([p.rows for p in parts]), merge_meta(*(p.meta for p in parts)))

    def save(self, path: str) -> None:
        """Rows as Parquet, constants as one JSON line beside them."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        line = self.rows.sparkSession.createDataFrame([(json.dumps(self.meta, sort_keys=True),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Batch:
        return Batch(spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first().value))


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Rename columns pairwise."""
    if len(old) != len(new):
        raise ValueError("old and new must have equal length")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Aligned column merge on ``row_id``.  Every row must be on both sides
    and shared columns must be equal, else the job fails."""
    shared = [c for c in a.columns if c in b.columns and c != ROW_ID]
    aa, bb = a.withColumn("_in", F.lit(True)).alias("a"), b.withColumn("_in", F.lit(True)).alias("b")
    j = aa.join(bb, F.col(f"a.{ROW_ID}") == F.col(f"b.{ROW_ID}"), "full_outer")
    wrong = F.col("a._in").isNull() | F.col("b._in").isNull()
    for c in shared:
        wrong = wrong | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    checked = j.withColumn("_chk", F.when(wrong, F.raise_error(
        F.lit("union: a row is missing on one side or a shared column differs"))).otherwise(F.lit(True)))
    cols = [F.col(f"a.{c}").alias(c) for c in a.columns] + \
        [F.col(f"b.{c}").alias(c) for c in b.columns if c not in a.columns]
    # filtering on the check keeps it in the plan (an unused column is pruned)
    return checked.filter(F.col("_chk")).select(*cols)


def store_bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets of ``row_id``, sorted in each: tables
    stored with the same number of buckets are merged on ``row_id`` (B6, B10) without
    a shuffle of either. The rows are dealt once here, a file a bucket; the table lies
    in the application's shared folder and is registered under ``name``."""
    spark = df.sparkSession
    (df.repartition(buckets, ROW_ID).write.bucketBy(buckets, ROW_ID).sortBy(ROW_ID).mode("overwrite").option("compression", "zstd")
     .option("path", scratch_path(spark, f"bucketed-{name}")).saveAsTable(name))
    return spark.table(name)


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation; ``row_id`` re-based by the sizes of the parts before."""
    out, offset = None, 0
    for p in parts:
        shifted = p.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(offset))
        offset += dense_size(p)
        out = shifted if out is None else out.unionByName(shifted)
    return out


def chunk(df: DataFrame, chunks: int, n: int | None = None, out: str = "chunk_id") -> DataFrame:
    """``chunks`` equal contiguous pieces; the size must divide evenly."""
    n = dense_size(df) if n is None else n
    if n % chunks != 0:
        raise ValueError(f"{n} rows cannot be cut into {chunks} equal pieces")
    return df.withColumn(out, (F.col(ROW_ID) / F.lit(n // chunks)).cast("long"))


def split(df: DataFrame, size: int, out: str = "chunk_id") -> DataFrame:
    """``len // size`` chunks through :func:`chunk` (non-divisible fails)."""
    n = dense_size(df)
    return chunk(df, n // size, n, out)


def reorder(df: DataFrame, perm: DataFrame, new_pos: str = "new_pos") -> DataFrame:
    """Apply a permutation given as ``(row_id, new_pos)``; both sides of it
    must number all rows."""
    if not dense_size(perm) == dense_size(perm, new_pos) == dense_size(df):
        raise ValueError("the permutation does not cover every row")
    j = df.join(perm.select(ROW_ID, new_pos), ROW_ID)
    return j.drop(ROW_ID).withColumnRenamed(new_pos, ROW_ID)


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Repeat every row; interleaved a,a,b,b or blocked a,b,a,b."""
    r = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    out = df.withColumn("_r", r)
    if interleave:
        new_id = F.col(ROW_ID) * times + F.col("_r")
    else:
        n = dense_size(df) if n is None else n
        new_id = F.col("_r") * n + F.col(ROW_ID)
    return out.withColumn(ROW_ID, new_id).drop("_r")


def pad_to_divisor(df: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Append rows from the head, cyclically, until ``len % k == 0``.
    Row ``i`` is copied to ids ``N + i + j*N`` for every ``j`` below the pad."""
    n = dense_size(df)
    pad = (k - n % k) % k
    if pad == 0:
        return df, 0
    copies = F.sequence(F.lit(0), F.lit((pad - 1) // n + 1))
    out = df.withColumn("_j", F.explode(copies))
    new_id = F.when(F.col("_j") == 0, F.col(ROW_ID)).otherwise(F.col(ROW_ID) + F.col("_j") * n)
    out = out.withColumn(ROW_ID, new_id).filter(F.col(ROW_ID) < n + pad).drop("_j")
    return out, pad


def unpad(df: DataFrame, pad: int, n: int | None = None) -> DataFrame:
    """Drop the last ``pad`` rows."""
    if pad == 0:
        return df
    n = dense_size(df) if n is None else n
    return df.filter(F.col(ROW_ID) < n - pad)


def fold_batch_dim(df: DataFrame, m: int, n: int | None = None) -> DataFrame:
    """``[N, ...] → [m, N/m, ...]`` as index columns ``(fold, inner)``;
    rows stay rows (no group is collected into one value)."""
    n = dense_size(df) if n is None else n
    if n % m != 0:
        raise ValueError(f"batch size {n} is not divisible by {m}")
    per = n // m
    return df.withColumn("fold", (F.col(ROW_ID) / per).cast("long")).withColumn("inner", F.col(ROW_ID) % per)


def seeded_order(*parts) -> Column:
    """A hash that any engine reproduces: md5 of the parts joined by ``:``."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def minibatches(df: DataFrame, size: int, epochs: int, seed: int | None = None) -> DataFrame:
    """Per epoch, ``minibatch = rank div size``; rank by ``row_id`` or, with
    a seed, by ``md5(seed:epoch:row_id)``.  Requires divisibility."""
    n = dense_size(df)
    if n % size != 0:
        raise ValueError(f"batch size {n} is not divisible by mini-batch size {size}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        out = out.withColumn("_rank", F.col(ROW_ID))
    else:
        from trellis.operators.sequence import ranked

        out = out.withColumn("_h", seeded_order(seed, F.col("epoch"), F.col(ROW_ID)))
        out = ranked(out, ["epoch"], ["_h", ROW_ID], "_rank").drop("_h")
    return out.withColumn("minibatch", (F.col("_rank") / size).cast("long")).drop("_rank")


def take(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """``batch[i]`` / ``batch[start:stop]``."""
    if stop is None:
        return df.filter(F.col(ROW_ID) == start)
    return df.filter((F.col(ROW_ID) >= start) & (F.col(ROW_ID) < stop))


def size_report(df: DataFrame) -> DataFrame:
    """Gigabytes per part: fixed-width columns (numbers, arrays of
    numbers at 8 bytes per element) and object columns (strings in bytes)."""
    fixed, obj = F.lit(0.0), F.lit(0.0)
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, Ty.ArrayType) and not isinstance(t.elementType, Ty.StringType):
            fixed = fixed + F.coalesce(F.size(f.name), F.lit(0)) * 8.0
        elif isinstance(t, (Ty.LongType, Ty.DoubleType, Ty.IntegerType, Ty.FloatType, Ty.BooleanType)):
            fixed = fixed + 8.0
        elif isinstance(t, Ty.StringType):
            obj = obj + F.coalesce(F.octet_length(f.name), F.lit(0)).cast("double")
    return df.agg((F.sum(fixed) / 1024 ** 3).alias("batch_gb"), (F.sum(obj) / 1024 ** 3).alias("non_tensor_gb"))


def collate(df: DataFrame, batch: str, cols: Sequence[str], max_rows: int = 4096) -> DataFrame:
    """Rows → one row per batch with array columns in ``row_id`` order, for
    a model boundary. A batch of more than ``max_rows`` rows fails the job: the
    caller cuts batches first (D4)."""
    s = F.sort_array(F.collect_list(F.struct(ROW_ID, *cols)))
    too_many = F.raise_error(F.concat(F.lit("a batch has more rows than "), F.lit(str(max_rows))))
    sized = df.join(df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")), batch)
    bounded = sized.filter(F.when(F.col("_n") <= max_rows, F.lit(True)).otherwise(too_many.cast("boolean")))
    return bounded.groupBy(batch).agg(s.alias("_s")).select(batch, *[F.col("_s")[c].alias(c) for c in cols])


def map_chunks(df: DataFrame, fn, schema) -> DataFrame:
    """Run ``fn`` on every chunk of rows as Arrow record batches."""
    return df.mapInArrow(fn, schema)


def register_chunk_function(spark: SparkSession, name: str, start, step, schema: str, end=None) -> None:
    """B21 as a table function for SQL:
    ``SELECT * FROM name(TABLE(t) PARTITION BY chunk ORDER BY row_id)``.

    Spark deals the chunks, in their order, to the tasks; a chunk is folded row by row
    (``start() -> state``, ``step(state, row) -> (state, rows out)``, and after its last
    row ``end(state) -> rows out``), so it is never held as a whole, however long."""

    class Chunk:
        def __init__(self):
            self.state = start()

        def eval(self, row: Ty.Row):
            self.state, out = step(self.state, row)
            yield from out

        def terminate(self):
            if end is not None:
                yield from end(self.state)

    ship_package(spark)
    spark.udtf.register(name, F.udtf(Chunk, returnType=schema))


def broadcast_args(df: DataFrame, args: DataFrame, on: Sequence[str], max_rows: int = 100_000) -> DataFrame:
    """The same table for every row. ``args`` is broadcast when it was
    counted to have at most ``max_rows`` rows; else it is an ordinary join."""
    small = args.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(args) if small else args, list(on), "left")


def gather_slice(df: DataFrame, world: int, rank_col: str = "rank") -> DataFrame:
    """Every rank sees all rows, then keeps its contiguous 1/world part:
    expressed directly as the part assignment (B8) — no copy per rank."""
    return chunk(df, world, out=rank_col)


def assign_uid(df: DataFrame, step: str = "step", out: str = "uid") -> DataFrame:
    """Deterministic prompt id (survives task retries), made before repeat."""
    return df.withColumn(out, F.sha2(F.concat_ws("|", F.col(step).cast("string"), F.col(ROW_ID).cast("string")), 256))


def strided_shard(df: DataFrame, world: int, out: str = "shard") -> DataFrame:
    """Round-robin ``data[i::world]``."""
    return df.withColumn(out, F.pmod(F.col(ROW_ID), F.lit(world)))
