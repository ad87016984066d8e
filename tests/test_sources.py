"""Readers and writers (A*) on both prediction-file layouts."""

import json
import os
import tempfile

from trellis.sources import io as IO


def test_read_predictions_flat_files(spark):
    folder = tempfile.mkdtemp(prefix="preds-")
    rows = {"hotpotqa": [{"pred": "a", "answers": ["a"], "all_classes": None, "length": 10, "raw_pred": "a"}],
            "trec": [{"pred": "b", "answers": ["c"], "all_classes": ["b", "c"], "length": 20, "raw_pred": "b"},
                     {"pred": "c", "answers": ["c"], "all_classes": ["b", "c"], "length": 30, "raw_pred": "c"}]}
    for name, items in rows.items():
        with open(os.path.join(folder, f"{name}.jsonl"), "w", encoding="utf-8") as f:
            for it in items:
                f.write(json.dumps(it) + "\n")
    with open(os.path.join(folder, "result.json"), "w") as f:
        f.write("{}")
    df = IO.read_predictions(spark, folder)
    got = sorted((r.dataset, r.pred, r.length) for r in df.collect())
    assert got == [("hotpotqa", "a", 10), ("trec", "b", 20), ("trec", "c", 30)]


def test_read_json_examples_none_and_suffix(spark):
    assert IO.read_json_examples(spark, None) is None
    try:
        IO.read_json_examples(spark, "/data/train.parquet")
    except ValueError:
        pass
    else:
        raise AssertionError("non-JSON path accepted")


def test_split_selection(spark):
    import pytest

    from trellis.session import scratch_path

    path = scratch_path(spark, f"split-test-{os.getpid()}-{id(spark)}")
    spark.range(5).write.mode("overwrite").parquet(f"{path}/folders/test")
    assert IO.read_examples(spark, f"{path}/folders@test").count() == 5
    spark.range(7).write.mode("overwrite").parquet(f"{path}/plain")
    assert IO.read_examples(spark, f"{path}/plain").count() == 7
    with pytest.raises(ValueError, match="no split"):
        IO.read_examples(spark, f"{path}/plain@test")
    with pytest.raises(FileNotFoundError):
        IO.read_examples(spark, f"{path}/nowhere")


def test_a_failed_append_leaves_nothing(spark):
    import pytest
    from pyspark.sql import functions as F

    from trellis.session import scratch_path

    path = scratch_path(spark, f"append-test-{os.getpid()}-{id(spark)}")
    good = spark.range(20).select(F.lit("trec").alias("dataset"), F.col("id").cast("string").alias("pred"))
    IO.append_predictions(good, path)
    broken = spark.range(20, 400).repartition(6).select(
        F.when(F.col("id") % 2 == 0, "lsht").otherwise("trec").alias("dataset"),
        F.when(F.col("id") == 333, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("id").cast("string")).alias("pred"))
    with pytest.raises(Exception, match="lost"):
        IO.append_predictions(broken, path)
    kept = IO.read_predictions(spark, path)
    assert sorted(int(r.pred) for r in kept.collect()) == list(range(20)) and {r.dataset for r in kept.collect()} == {"trec"}


def test_both_layouts_in_either_order(spark):
    """Reading partitioned folders does not change how flat files are read."""
    from pyspark.sql import functions as F

    from trellis.session import scratch_path

    path = scratch_path(spark, f"layout-test-{os.getpid()}-{id(spark)}")
    IO.append_predictions(spark.range(3).select(F.lit("trec").alias("dataset"), F.lit("x").alias("pred")), path)
    before = list(IO.PREDICTION_SCHEMA.names)
    assert IO.read_predictions(spark, path).count() == 3 and IO.PREDICTION_SCHEMA.names == before
    test_read_predictions_flat_files(spark)
