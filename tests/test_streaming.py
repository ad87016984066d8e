"""Streams drained with availableNow equal the batch jobs (SURVEY §5 (5))."""

import uuid

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from trellis.operators import curriculum as D
from trellis.plans.catalog import load
from trellis.session import scratch_path
from trellis.sources import views as V
from trellis.streaming import streams as S

QUERIES, _ = load()


def test_curriculum_stream_equals_batch(spark):
    stream = QUERIES["j4_curriculum_stream"](spark, SF_SMALL)
    main = V.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("row_id"))
    extra = V.table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("row_id"))
    steps = V.step_log(spark, SF_SMALL).select("step").distinct().count()
    batch = D.curriculum_mix(spark, main, extra, steps, 32, max_steps=30, seed=42).select("step", "slot", "source", "pick")
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_score_stream_equals_batch(spark):
    for stream, batch in (("j1_score_stream", "e8_evidence_reward_exact"), ("j1_score_stream_full", "e8_evidence_reward")):
        s, b = QUERIES[stream](spark, SF_SMALL), QUERIES[batch](spark, SF_SMALL)
        assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_adaptive_kl_stream_equals_batch(spark):
    s = QUERIES["j3_adaptive_kl_stream"](spark, SF_SMALL)
    b = QUERIES["g15_adaptive_kl"](spark, SF_SMALL)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def _steps(spark, order):
    """One file per step, written (and so streamed) in the given order."""
    path = scratch_path(spark, f"steps-{uuid.uuid4().hex}")
    for k in order:
        spark.createDataFrame([(r, 0.1 * (k + 1), 10 + k, 1.0, k) for r in ("a", "b")], S.STEP_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(path)
    return path


def test_early_steps_wait_and_gaps_raise(spark):
    run = lambda order: sorted(S.adaptive_kl_stream(
        spark, _steps(spark, order), 0.2, 0.3, 100.0, files_per_trigger=1).collect())
    first = run([0, 1, 2, 3, 4])
    assert len(first) == 10 and run([4, 2, 3, 0, 1]) == first and run([0, 0, 1, 2, 3, 4, 1]) == first
    with pytest.raises(ValueError, match="predecessor"):
        run([0, 1, 3])


def test_steps_with_uncoalesced_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert QUERIES["j3_adaptive_kl_stream"](spark, SF_SMALL).count() == V.step_log(spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_replayed_batch_overwrites_itself_and_equal_rows_stay(spark):
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    write = S._sink(path)
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert sorted(r.x for r in S.read_sink(spark, path, df.schema).collect()) == [1, 1, 1, 1, 2, 2]


def test_a_job_resumes_where_it_stopped(spark):
    """Stopped after each file, the runs together give what one run gives, and no row twice."""
    steps = [3, 0, 4, 1, 2]
    whole = sorted(S.adaptive_kl_stream(spark, _steps(spark, steps), 0.2, 0.3, 100.0).collect())
    path, home, sizes = scratch_path(spark, f"steps-{uuid.uuid4().hex}"), S.new_home(spark, "kl"), []
    for k in steps:
        spark.createDataFrame([(r, 0.1 * (k + 1), 10 + k, 1.0, k) for r in ("a", "b")], S.STEP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        done = S.adaptive_kl_stream(spark, path, 0.2, 0.3, 100.0, home=home, complete=False)
        sizes.append(done.count())
        waiting = {r.step for r in S.waiting_steps(S.stream_session(spark), home).collect()}
        assert waiting == {x for x in steps[:len(sizes)] if x >= sizes[-1] // 2}
    assert sizes == [0, 2, 2, 4, 10] and sorted(done.collect()) == whole
    again = S.adaptive_kl_stream(spark, path, 0.2, 0.3, 100.0, home=home)  # nothing new
    assert sorted(again.collect()) == whole


def test_crash_inside_a_micro_batch(spark, monkeypatch):
    path, home = scratch_path(spark, f"rows-{uuid.uuid4().hex}"), S.new_home(spark, "metrics")
    for k in range(6):
        spark.createDataFrame([(k, f"m{i}", float(i)) for i in range(5)], S.METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    real = S._sink

    def breaking(at):
        write = real(at)

        def run(batch, batch_id):
            write(batch, batch_id)
            if batch_id == 1:  # written, but not committed
                raise RuntimeError("lost")
        return run

    monkeypatch.setattr(S, "_sink", breaking)
    with pytest.raises(Exception, match="lost"):
        S.log_stream(spark, path, home=home)
    monkeypatch.setattr(S, "_sink", real)
    rows = S.log_stream(spark, path, home=home)
    assert rows.count() == 30 and rows.distinct().count() == 30


def test_waiting_steps_are_bounded_while_the_stream_runs(spark):
    with pytest.raises(Exception, match="3 steps of run . wait for step 1"):
        S.adaptive_kl_stream(spark, _steps(spark, [0, 2, 3, 4]), 0.2, 0.3, 100.0, files_per_trigger=1, max_waiting=2)


def test_timer_reports_a_step_that_does_not_come(spark):
    s = S.stream_session(spark)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    steps = s.readStream.schema(S.STEP_SCHEMA).parquet(_steps(spark, [0, 2]))
    q = S.adaptive_kl(steps, 0.2, 0.3, 100.0, patience_ms=1000).writeStream.foreachBatch(lambda d, i: d.collect()).option(
        "checkpointLocation", S.new_home(spark, "kl") + "/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        with pytest.raises(Exception, match="step 1 of run . has not come"):
            assert not q.awaitTermination(90)
    finally:
        q.stop()


def test_steps_delivered_again_yield_nothing(spark):
    rows = lambda name: sorted(QUERIES[name](spark, SF_SMALL).collect())
    assert rows("j4_curriculum_resumed") == rows("j4_curriculum_stream")


def test_folders_are_asked_of_their_own_file_system(spark):
    path = scratch_path(spark, f"events-{uuid.uuid4().hex}.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS step", "'a' AS name", "1D AS value").coalesce(1).write.parquet(path)
    for form in (path, path if path.startswith("file:") else f"file://{path}"):
        assert S.is_folder(spark, form) and S.log_stream(spark, form).count() == 3
    assert not S.is_folder(spark, path + "-none")


def test_score_stream_takes_many_files_at_once(spark, tmp_path):
    """Twelve files are one micro-batch on any machine with three cores or more."""
    from trellis.sources import views as V
    from trellis.streaming import streams as S

    path, home = str(tmp_path / "docs"), str(tmp_path / "home")
    V.table(spark, SF_SMALL, "documents").repartition(12).write.parquet(path)
    n = S.score_stream(spark, path, V.responses_from, soft=False, home=home).count()
    assert n == V.table(spark, SF_SMALL, "documents").count()
    batches = [x for x in (tmp_path / "home" / "sink").iterdir() if x.name.startswith("trellis_batch_id")]
    assert len(batches) <= -(-12 // (S.FILES_PER_CORE * spark.sparkContext.defaultParallelism))
