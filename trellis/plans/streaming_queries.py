"""Registered streaming queries (J*): each drains its stream with an
``availableNow`` trigger and returns the sink as a batch table, so the
oracle is the batch result (stream = batch)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trellis.operators import curriculum as D
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.plans.reward_queries import _ACC, _RESP, _SPAN_SCORE
from trellis.plans.statistics_queries import _KL_HORIZON, _KL_INIT, _KL_TARGET, _MULT
from trellis.sources import io as IO
from trellis.sources import views as V
from trellis.streaming import streams as S


_J1 = _RESP + f"""
SELECT doc_id, {Q.r6(Q.evidence_format_sql('response'))} AS format_score, {Q.r6(_ACC)} AS accuracy,
       {Q.r6(_SPAN_SCORE)} AS span_score,
       {Q.r6(f"0.7 * ({_ACC}) + 0.1 * ({Q.evidence_format_sql('response')}) + 0.2 * ({_SPAN_SCORE})")} AS reward
FROM responses"""


@register("j1_score_stream", _J1)
def j1_score_stream(spark, sf_dir):
    """Verbatim spans only: what SQL can check."""
    return finish(S.score_stream(spark, f"{sf_dir}/documents.parquet", V.responses_from, soft=False))


@register("j1_score_stream_full")
def j1_score_stream_full(spark, sf_dir):
    """The full reward on arriving responses; equals the batch job (tested)."""
    return finish(S.score_stream(spark, f"{sf_dir}/documents.parquet", V.responses_from))


_J2 = f"""
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, {Q.r6('avg(value)')} AS mean_value, {Q.r6('max(value)')} AS max_value
FROM events GROUP BY ALL"""


@register("j2_metric_windows", _J2)
def j2_metric_windows(spark, sf_dir):
    return finish(S.metric_windows(spark, f"{sf_dir}/events.parquet"))


@register("j2_sliding_windows", f"""
WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS st FROM events)
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(st + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, {Q.r6('avg(value)')} AS mean_value, {Q.r6('max(value)')} AS max_value
FROM w GROUP BY ALL""")
def j2_sliding_windows(spark, sf_dir):
    """Day-long windows every half day."""
    return finish(S.metric_windows(spark, f"{sf_dir}/events.parquet", slide="12 hours"))


_FILES = 4


@register("j2_late_rows", f"""
WITH a AS (SELECT *, event_id % 10 = 0 AS later, time_bucket(INTERVAL 1 DAY, ts) AS st FROM events),
mark AS (SELECT max(ts) - INTERVAL 6 HOUR AS w FROM a WHERE event_id % 10 > 1)
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(st + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, {Q.r6('avg(value)')} AS mean_value, {Q.r6('max(value)')} AS max_value
FROM a, mark WHERE NOT later OR st + INTERVAL 1 DAY > w GROUP BY ALL""")
def j2_late_rows(spark, sf_dir):
    """A tenth of the events arrives after all others: rows whose window the
    watermark has passed by then are dropped, the rest updates its window.
    (Spark holds late rows against the watermark of the micro-batch before the
    last, hence the second tenth in between.)"""
    path = IO.scratch_path(spark, f"events-{uuid.uuid4().hex}")
    ev, tenth = V.table(spark, sf_dir, "events"), F.col("event_id") % 10
    for part in (tenth > 1, tenth == 1, tenth == 0):  # micro-batches, in the order of writing
        ev.where(part).repartition(_FILES).write.mode("append").parquet(path)
    return finish(S.metric_windows(spark, path, maxFilesPerTrigger=_FILES))


@register("j2_session_metrics", f"""
WITH e AS (SELECT user_id, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e),
g AS (SELECT user_id, sid, min(ts) AS st, max(ts) + INTERVAL 2 HOUR AS en, count(*) AS n, sum(value) AS total_value
      FROM s GROUP BY user_id, sid)
SELECT user_id, strftime(st, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S') AS session_end,
       n, {Q.r6('total_value')} AS total_value
FROM g WHERE en <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")
def j2_session_metrics(spark, sf_dir):
    """Gap-based sessions per user; append mode emits the sessions the
    watermark (latest event time - 6 h) has closed."""
    return finish(S.session_metrics(spark, f"{sf_dir}/events.parquet"))


def _step_dir(spark, sf_dir):
    path = IO.scratch_path(spark, f"steplog-{uuid.uuid4().hex}")
    V.step_log(spark, sf_dir).write.partitionBy("step").parquet(path)
    return path


_J3 = f"""WITH {Q.STEP_LOG},
m AS (SELECT run, step, {_MULT} AS mult FROM step_log)
SELECT run, step,
  {Q.r6(f"{_KL_INIT} * exp(coalesce(sum(ln(mult)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))")} AS kl_coef,
  {Q.r6(f"{_KL_INIT} * exp(sum(ln(mult)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")} AS kl_coef_next
FROM m"""


@register("j3_adaptive_kl_stream", _J3)
def j3_adaptive_kl_stream(spark, sf_dir):
    return finish(S.adaptive_kl_stream(spark, _step_dir(spark, sf_dir), _KL_INIT, _KL_TARGET, _KL_HORIZON))


_J4 = f"""WITH {Q.STEP_LOG},
sizes AS (SELECT (SELECT count(*) FROM documents) AS n_main, (SELECT count(*) FROM benchmark) AS n_extra),
slots AS (SELECT step::BIGINT AS step, slot FROM step_log, range(32) t(slot) WHERE run = 'view'),
drawn AS (
  SELECT step, slot, {Q.draw_sql("'42'", "step", "slot", "'source'")} / {float(1 << 52)} < least(0.5, step / 30.0 * 0.5) AS extra,
         {Q.draw_sql("'42'", "step", "slot", "'index'")} AS u FROM slots)
SELECT step, slot, CASE WHEN extra THEN 'extra' ELSE 'main' END AS source,
       u % CASE WHEN extra THEN n_extra ELSE n_main END AS pick FROM drawn, sizes"""


def _feeds(spark, sf_dir):
    """The static sources of J4."""
    main = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return main, V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"))


@register("j4_curriculum_stream", _J4)
def j4_curriculum_stream(spark, sf_dir):
    """Step stream joined to the static sources; equals the batch feed."""
    ss = S.stream_session(spark)
    return S.curriculum_stream(spark, _step_dir(spark, sf_dir), "view", *_feeds(ss, sf_dir), 32, 30)


# ---------------------------------------------------- stopped and started again

def _lots(df, first):
    """Write the rows where ``first`` holds; returns the folder and what adds the rest."""
    path = IO.scratch_path(df.sparkSession, f"lots-{uuid.uuid4().hex}")
    df.where(first).write.parquet(path)
    return path, lambda rest: rest.write.mode("append").parquet(path)


@register("j1_score_stream_resumed", _J1)
def j1_score_stream_resumed(spark, sf_dir):
    """Half of the documents, a stop, and the other half from the checkpoint."""
    docs, even, home = V.table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0, S.new_home(spark, "score-stream")
    path, add = _lots(docs, even)
    S.score_stream(spark, path, V.responses_from, soft=False, home=home)
    add(docs.where(~even))
    return finish(S.score_stream(spark, path, V.responses_from, soft=False, home=home))


@register("j2_windows_resumed", _J2)
def j2_windows_resumed(spark, sf_dir):
    """Windows that are open at the stop go on from the checkpoint's state."""
    events, home = V.table(spark, sf_dir, "events"), S.new_home(spark, "metric-windows")
    early = F.col("event_id") % 2 == 0
    path, add = _lots(events, early)
    span = events.agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("s")).head().s
    delay = f"{(span or 0) // 1_000_000 + 1} seconds"  # the second lot is as old as the first: no row is late
    S.metric_windows(spark, path, delay=delay, home=home)
    add(events.where(~early))
    return finish(S.metric_windows(spark, path, delay=delay, home=home))


@register("j3_adaptive_kl_resumed", _J3)
def j3_adaptive_kl_resumed(spark, sf_dir):
    """The later steps come first and wait in the state; after the stop come all
    steps, the later ones once more."""
    steps, home = V.step_log(spark, sf_dir), S.new_home(spark, "adaptive-kl")
    path, add = _lots(steps, F.col("step") >= 10)
    kl = (_KL_INIT, _KL_TARGET, _KL_HORIZON)
    S.adaptive_kl_stream(spark, path, *kl, home=home, complete=False)
    add(steps)
    return finish(S.adaptive_kl_stream(spark, path, *kl, home=home))


@register("j4_curriculum_resumed", _J4)
def j4_curriculum_resumed(spark, sf_dir):
    """Steps of before the stop are delivered again after it and yield nothing."""
    ss, steps, home = S.stream_session(spark), V.step_log(spark, sf_dir), S.new_home(spark, "curriculum-stream")
    path, add = _lots(steps, F.col("step") < 12)
    S.curriculum_stream(spark, path, "view", *_feeds(ss, sf_dir), 32, 30, home=home)
    add(steps)
    return S.curriculum_stream(spark, path, "view", *_feeds(ss, sf_dir), 32, 30, home=home)


@register("a10_resume_after_stop", _J4)
def a10_resume_after_stop(spark, sf_dir):
    """A feed that stopped goes on as a batch job after the last step of its sink."""
    ss, steps = S.stream_session(spark), V.step_log(spark, sf_dir).where("run = 'view'")
    path, _ = _lots(steps, F.col("step") < 12)
    fed = S.curriculum_stream(spark, path, "view", *_feeds(ss, sf_dir), 32, 30)
    n_steps = S.last_step(steps) + 1
    rest = D.resume_feed(D.curriculum_mix(spark, *_feeds(spark, sf_dir), n_steps, 32, max_steps=30, seed=42), S.last_step(fed))
    return fed.unionByName(rest.select("step", "slot", "source", "pick"))
