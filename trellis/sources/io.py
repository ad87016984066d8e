"""Readers and writers (A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from trellis.session import scratch_path  # noqa: F401  (also used by callers of this module)

# Schema of one prediction line (A5 / A4).
PREDICTION_SCHEMA = Ty.StructType([
    Ty.StructField("pred", Ty.StringType()),
    Ty.StructField("answers", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("all_classes", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("length", Ty.LongType()),
    Ty.StructField("raw_pred", Ty.StringType()),
])


def parse_path(spec: str) -> tuple[str, str]:
    """``path@split`` → (path, split); split defaults to ``train``."""
    if "@" in spec:
        path, split = spec.rsplit("@", 1)
        return path, split
    return spec, "train"


def read_examples(spark: SparkSession, spec: str) -> DataFrame:
    """A1: ``path`` or ``path@split`` → the parquet rows of that split: the
    sub-folder named like the split, else the rows whose ``split`` column says so.
    Without either the path holds one split, ``train``; asking for another is an
    error. A remote dataset hub is not built."""
    path, split = parse_path(spec)
    names = _list(spark, path)
    if not names:
        raise FileNotFoundError(f"{path}: no such folder or file (remote dataset hubs are not supported)")
    if split in names or f"{split}.parquet" in names:
        return spark.read.parquet(f"{path}/{split if split in names else split + '.parquet'}")
    df = spark.read.parquet(path)
    if "split" in df.columns:
        return df.where(F.col("split") == split).drop("split")
    if split != "train":
        raise ValueError(f"{path} has no split {split!r}")
    return df


def read_json_examples(spark: SparkSession, path: str | None, schema: Ty.StructType | None = None) -> DataFrame | None:
    """A2: ``.json``/``.jsonl`` → JSON lines reader; ``None`` → no extra set
    (curriculum off)."""
    if path is None:
        return None
    if not (path.endswith(".json") or path.endswith(".jsonl")):
        raise ValueError(f"{path}: only .json / .jsonl files are read")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """A3: write JSON lines."""
    df.write.mode("overwrite").json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """A5: append one JSON object per line, UTF-8, one folder per dataset."""
    cols = [c for c in ("pred", "answers", "all_classes", "length", "raw_pred") if c in df.columns]
    df.select("dataset", *cols).write.mode("append").partitionBy("dataset").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A4: every prediction file under ``path``.  Folders written by
    :func:`append_predictions` carry the dataset as a partition column; flat
    ``<dataset>.jsonl`` files take it from the file name up to the first dot."""
    has_partitions = any(name.startswith("dataset=") for name in _list(spark, path))
    if has_partitions:
        return spark.read.schema(Ty.StructType([*PREDICTION_SCHEMA.fields, Ty.StructField("dataset", Ty.StringType())])).json(path)
    df = spark.read.schema(PREDICTION_SCHEMA).json(f"{path}/*.jsonl")
    return df.withColumn("dataset", F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1)))


def _list(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def write_report(scores: DataFrame, path: str, key: str = "dataset", value: str = "score") -> None:
    """``{dataset: score}`` as one JSON object (the report is tiny)."""
    obj = scores.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value))))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)


def save_batch(df: DataFrame, path: str) -> None:
    """Persist a batch (parquet); with constants: :class:`trellis.operators.batch.Batch`."""
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    """Load a saved batch."""
    return spark.read.parquet(path)
