"""Streaming jobs.

Every job reads a file stream, applies the same column builders and
operators as the batch jobs, and writes through ``foreachBatch`` into one folder
per micro-batch: a replayed micro-batch overwrites its own folder, so the sink
holds every row exactly once.  Sinks and checkpoints live in the shared
checkpoint folder.  ``run_available_now`` drains everything available and stops,
which makes ``stream == batch`` testable.

A job's ``home`` is the folder of its checkpoint and sink. Called again with the
same home, it goes on where it stopped, also after a crash inside a micro-batch:
files are read once, state is kept, and the returned table holds the rows of all
runs.  Without a home a job starts anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trellis.operators.curriculum import draws
from trellis.operators.rewards import score_evidence
from trellis.sources.io import scratch_path

_BATCH_ID = "trellis_batch_id"


def _sink(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH_ID}={batch_id}")

    return write


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session for streaming jobs: state partitions are fixed when a
    stream first starts, so size them to the cluster's cores rather than the
    batch shuffle width."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return s


def new_home(spark: SparkSession, name: str) -> str:
    """A fresh home for a job, in the shared folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append", home: str | None = None) -> str:
    """Run ``stream`` until the available input is consumed; returns the sink path.
    With the ``home`` of an earlier run it resumes from that run's checkpoint."""
    home = home or new_home(stream.sparkSession, name)
    q = (stream.writeStream.queryName(name.replace("-", "_")).outputMode(output_mode).foreachBatch(_sink(f"{home}/sink"))
         .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{home}/sink"


def read_sink(spark: SparkSession, path: str, schema: Ty.StructType, keys: list[str] | None = None) -> DataFrame:
    """Read a sink back; with ``keys`` keep the latest micro-batch's row per key
    (update-mode aggregates)."""
    df = spark.read.schema(Ty.StructType([*schema.fields, Ty.StructField(_BATCH_ID, Ty.LongType())])).parquet(path)
    if keys:
        latest = df.groupBy(*keys).agg(F.max(_BATCH_ID).alias(_BATCH_ID))
        df = df.join(latest, [*keys, _BATCH_ID])
    return df.select(*[f.name for f in schema.fields])


# ---------------------------------------------------------------- J1

def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system has a folder there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def file_stream(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A parquet file stream over a folder; a single file is streamed by
    watching its folder with a file-name filter."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    if path.endswith(".parquet") and not is_folder(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder or ".")
    return reader.parquet(path)


EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: Files of a scoring micro-batch for each core: a file is little more than a task.
FILES_PER_CORE = 4


def score_stream(spark: SparkSession, source_dir: str, responses_fn, soft: bool = True, home: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Evidence reward on arriving responses, the batch scorer unchanged
    (``soft=False``: verbatim spans only).  A micro-batch takes so many files that
    every core has work."""
    batch_spark, spark = spark, stream_session(spark)
    docs = file_stream(spark, source_dir, "doc_id long, text string, lang string, source string, n_chars long",
                       maxFilesPerTrigger=files_per_trigger or FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    scored = score_evidence(responses_fn(docs), "doc_id", soft=soft).select(
        "doc_id", "format_score", "accuracy", "span_score", "reward")
    sink = run_available_now(scored, "score-stream", home=home)
    return read_sink(batch_spark, sink, scored.schema)


# ---------------------------------------------------------------- J2

def metric_windows(spark: SparkSession, events_dir: str, window: str = "1 day", delay: str = "6 hours",
                   slide: str | None = None, home: str | None = None, **options) -> DataFrame:
    """Per event type and tumbling (or sliding) event-time window: count,
    mean and max value, with a watermark; rows later than the watermark are
    dropped by the engine."""
    batch_spark, spark = spark, stream_session(spark)
    ev = file_stream(spark, events_dir, EVENTS_SCHEMA, **options)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = (ev.groupBy(w.alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")))
    out = agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                     "event_type", "n", "mean_value", "max_value")
    sink = run_available_now(out, "metric-windows", output_mode="update", home=home)
    return read_sink(batch_spark, sink, out.schema, keys=["window_start", "window_end", "event_type"])


def session_metrics(spark: SparkSession, events_dir: str, gap: str = "2 hours", delay: str = "6 hours",
                    home: str | None = None) -> DataFrame:
    """J2 (session form): per user activity session (gap-based)."""
    batch_spark, spark = spark, stream_session(spark)
    ev = file_stream(spark, events_dir, EVENTS_SCHEMA)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    agg = ev.groupBy(F.session_window("ts", gap).alias("s"), "user_id") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
    out = agg.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
                     F.date_format("s.end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n", "total_value")
    sink = run_available_now(out, "session-metrics", home=home)
    return read_sink(batch_spark, sink, out.schema)


# ---------------------------------------------------------------- J3

_KL_OUT = Ty.StructType([Ty.StructField("run", Ty.StringType()), Ty.StructField("step", Ty.IntegerType()),
                         Ty.StructField("kl_coef", Ty.DoubleType()), Ty.StructField("kl_coef_next", Ty.DoubleType())])
STEP_SCHEMA = "run string, kl double, n long, seconds double, step int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KlController(StatefulProcessor):
    """The adaptive KL coefficient of a run, updated in step order.

    State: the coefficient, the step that is due and how many steps wait (a value);
    the steps that came before their predecessor (a map, by step). A step that comes
    again is skipped. More than ``max_waiting`` waiting steps are an error at once;
    with ``patience_ms`` a timer raises when the due step does not come in that time."""

    def __init__(self, init: float, target: float, horizon: float, first_step: int, max_waiting: int, patience_ms: int | None):
        self.first, self.target, self.horizon = (init, first_step, 0), target, horizon
        self.max_waiting, self.patience_ms = max_waiting, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "coef double, due int, waiting int")
        self.waiting = handle.getMapState("waiting", "step int", "kl double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        coef, due, n_waiting = self.value.get() if self.value.exists() else self.first
        out, before = [], due
        for pdf in rows:
            for step, kl, n in zip(pdf["step"].tolist(), pdf["kl"].tolist(), pdf["n"].tolist()):
                if step >= due and not self.waiting.containsKey((step,)):
                    self.waiting.updateValue((step,), (kl, n))
                    n_waiting += 1
        while n_waiting and self.waiting.containsKey((due,)):
            kl, n = self.waiting.getValue((due,))
            self.waiting.removeKey((due,))
            error = min(max(kl / self.target - 1.0, -0.2), 0.2)
            after = coef * (1.0 + error * n / self.horizon)
            out.append((key[0], due, coef, after))
            coef, due, n_waiting = after, due + 1, n_waiting - 1
        if n_waiting > self.max_waiting:
            raise ValueError(f"{n_waiting} steps of run {key[0]} wait for step {due}: without their predecessor")
        if self.patience_ms is not None:
            self._wait(timerValues, n_waiting, due != before)
        self.value.update((coef, due, n_waiting))
        yield pd.DataFrame(out, columns=["run", "step", "kl_coef", "kl_coef_next"])

    def _wait(self, timers, n_waiting: int, moved: bool) -> None:
        """One timer while steps wait, set anew when the due step changes."""
        old = [x for (x,) in ((t,) if isinstance(t, int) else tuple(t) for t in self.handle.listTimers())]
        if moved or not n_waiting:
            for t in old:
                self.handle.deleteTimer(t)
            old = []
        if n_waiting and not old:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, due, n_waiting = self.value.get()
        raise ValueError(f"step {due} of run {key[0]} has not come: {n_waiting} steps wait without their predecessor")

    def close(self) -> None:
        pass


def adaptive_kl(steps: DataFrame, init: float, target: float, horizon: float, first_step: int = 0, max_waiting: int = 10_000,
                patience_ms: int | None = None) -> DataFrame:
    """J3 as a streaming DataFrame over ``steps`` (STEP_SCHEMA). ``patience_ms`` needs
    a trigger that goes on without new data (not ``availableNow``)."""
    return steps.groupBy("run").transformWithStateInPandas(
        KlController(init, target, horizon, first_step, max_waiting, patience_ms), _KL_OUT, "Append",
        "none" if patience_ms is None else "processingTime")


def adaptive_kl_stream(spark: SparkSession, step_dir: str, init: float, target: float, horizon: float,
                       first_step: int = 0, files_per_trigger: int = 10, max_waiting: int = 10_000,
                       home: str | None = None, complete: bool = True) -> DataFrame:
    """The adaptive KL coefficient as per-run state, updated in step order
    whatever order the files come in: a step that is early waits in the state for
    its predecessor, a replayed one is skipped.  Steps that still wait when the stream
    has been drained are an error, unless the run is to be resumed (``complete=False``);
    they are read from the state, not from the input."""
    batch_spark, spark = spark, stream_session(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    home = home or new_home(spark, "adaptive-kl")
    steps = spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(step_dir)
    sink = run_available_now(adaptive_kl(steps, init, target, horizon, first_step, max_waiting), "adaptive-kl", home=home)
    if complete:
        left = waiting_steps(spark, home).groupBy("run").agg(F.min("step").alias("step")).limit(5).collect()
        if left:
            raise ValueError(f"steps without their predecessor: {[(r.run, r.step) for r in left]}")
    return read_sink(batch_spark, sink, _KL_OUT)


def waiting_steps(spark: SparkSession, home: str) -> DataFrame:
    """(run, step) of the steps that wait in the state of a J3 run."""
    state = spark.read.format("statestore").option("path", f"{home}/checkpoint").option("stateVarName", "waiting").load()
    return state.select(F.col("key.run").alias("run"), F.col("user_map_key.step").alias("step"))


# ---------------------------------------------------------------- J4

def curriculum_stream(spark: SparkSession, step_dir: str, run: str, main: DataFrame, extra: DataFrame, batch_size: int,
                      max_steps: int, seed: int = 42, home: str | None = None) -> DataFrame:
    """Each arriving step of one run expands to its slots, draws source and
    row (the batch feed's own draw) and joins the static sources.  A step that is
    delivered again yields nothing: the step numbers are the stream's clock, and a
    step is remembered until the run is ``max_steps`` further, so the state is bounded
    and a step up to that much behind is never late."""
    from trellis.operators.batch import dense_size

    n_main, n_extra = dense_size(main), dense_size(extra)
    batch_spark, spark = spark, main.sparkSession
    steps = spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", 10).parquet(step_dir).where(F.col("run") == run)
    steps = steps.withColumn("clock", F.timestamp_seconds(F.col("step") + 1)).withWatermark("clock", f"{max_steps} seconds").dropDuplicatesWithinWatermark(["run", "step"])
    slots = steps.select(F.col("step").cast("long").alias("step"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch_size - 1).cast("long"))).alias("slot"))
    m = main.select(F.lit("main").alias("source"), F.col("row_id").alias("pick"))
    e = extra.select(F.lit("extra").alias("source"), F.col("row_id").alias("pick"))
    out = draws(slots, n_main, n_extra, max_steps, seed).join(m.unionByName(e), ["source", "pick"]) \
        .select("step", "slot", "source", "pick")
    return read_sink(batch_spark, run_available_now(out, "curriculum-stream", home=home), out.schema)


def last_step(fed: DataFrame, step: str = "step") -> int:
    """The last step of a stored feed, -1 if there is none: where A10 resumes."""
    return int(fed.agg(F.coalesce(F.max(step), F.lit(-1)).alias("s")).head().s)


# ---------------------------------------------------------------- A8

METRIC_SCHEMA = "step int, name string, value double"


def log_stream(spark: SparkSession, source_dir: str, files_per_trigger: int = 2, home: str | None = None) -> DataFrame:
    """A8 as a stream: arriving ``(step, name, value)`` rows go to the metrics
    table, one folder per micro-batch; returns the table."""
    batch_spark, spark = spark, stream_session(spark)
    rows = file_stream(spark, source_dir, METRIC_SCHEMA, maxFilesPerTrigger=files_per_trigger)
    return read_sink(batch_spark, run_available_now(rows, "metrics", home=home), rows.schema)
