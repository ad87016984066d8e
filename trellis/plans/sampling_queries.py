"""Registered queries for curriculum sampling (D*), balancing (H*) and I/O (A*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators import balance as H
from trellis.operators import curriculum as D
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.sources import io as IO
from trellis.sources import views as V

# ------------------------------------------------------------------ D*


@register("d1_mix_ratio", f"""WITH {Q.STEP_LOG}
SELECT run, step, {Q.r6('least(0.5, step / 20.0 * 0.5)')} AS ratio FROM step_log""")
def d1_mix_ratio(spark, sf_dir):
    sl = V.step_log(spark, sf_dir)
    return finish(sl.select("run", "step", D.mix_ratio("step", 20).alias("ratio")))


def _sources(spark, sf_dir):
    main = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    extra = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"))
    return main, extra


_BATCH = 32


_FEED = f"""
sizes AS (SELECT (SELECT count(*) FROM documents) AS n_main, (SELECT count(*) FROM benchmark) AS n_extra),
steps AS (SELECT greatest(n_main, n_extra) // {_BATCH} AS n FROM sizes),
slots AS (SELECT step, slot FROM range((SELECT n FROM steps)) s(step), range({_BATCH}) t(slot)),
drawn AS (
  SELECT step, slot, {Q.draw_sql("'42'", "step", "slot", "'source'")} / {float(1 << 52)} < least(0.5, step / (SELECT n FROM steps)::DOUBLE * 0.5) AS extra,
         {Q.draw_sql("'42'", "step", "slot", "'index'")} AS u FROM slots)"""
_FEED_COLUMNS = """SELECT step, slot, CASE WHEN extra THEN 'extra' ELSE 'main' END AS source,
       u % CASE WHEN extra THEN n_extra ELSE n_main END AS pick FROM drawn, sizes"""


def _feed(spark, sf_dir):
    main, extra = _sources(spark, sf_dir)
    steps = D.epoch_length(main, extra).first().epoch_length // _BATCH
    return D.curriculum_mix(spark, main, extra, steps, _BATCH, max_steps=steps, seed=42).select("step", "slot", "source", "pick")


@register("d2_curriculum_mix", f"WITH {_FEED} {_FEED_COLUMNS}")
def d2_curriculum_mix(spark, sf_dir):
    """Curriculum feed for one epoch over the whole main set."""
    return _feed(spark, sf_dir)


@register("d6_extra_share", f"""WITH {_FEED}
SELECT step, count(*) AS n_slots, sum(extra::INTEGER)::BIGINT AS n_extra FROM drawn GROUP BY step""")
def d6_extra_share(spark, sf_dir):
    """How many of each step's draws come from the extra set."""
    return _feed(spark, sf_dir).groupBy("step").agg(
        F.count(F.lit(1)).alias("n_slots"), F.sum((F.col("source") == "extra").cast("long")).alias("n_extra"))


@register("d3_epoch_length", """
SELECT greatest((SELECT count(*) FROM documents), (SELECT count(*) FROM benchmark)) AS epoch_length""")
def d3_epoch_length(spark, sf_dir):
    return D.epoch_length(*_sources(spark, sf_dir))


@register("d4_batches_sequential", f"""
SELECT doc_id AS row_id, doc_id AS position, doc_id // {_BATCH} AS batch_id FROM documents
WHERE doc_id // {_BATCH} < (SELECT count(*) FROM documents) // {_BATCH}""")
def d4_batches_sequential(spark, sf_dir):
    main, _ = _sources(spark, sf_dir)
    return D.batches(main, _BATCH).select("row_id", "position", "batch_id")


@register("d4_batches_shuffled", f"""
WITH r AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', '0', doc_id)), doc_id) - 1 AS position FROM documents)
SELECT row_id, position, position // {_BATCH} AS batch_id FROM r
WHERE position // {_BATCH} < (SELECT count(*) FROM documents) // {_BATCH}""")
def d4_batches_shuffled(spark, sf_dir):
    """Seeded order; every kept row once, full batches only."""
    main, _ = _sources(spark, sf_dir)
    return D.batches(main, _BATCH, seed=42).select("row_id", "position", "batch_id")


@register("d4_batches_of_orders", f"""
WITH r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT row_id, position, position // {_BATCH} AS batch_id FROM r""")
def d4_batches_of_orders(spark, sf_dir):
    """Ranks come from the order of the ids, not their values; the short last batch is kept."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return D.batches(o, _BATCH, drop_last=False).select("row_id", "position", "batch_id")


@register("d5_total_steps", f"""
SELECT count(*) AS n_rows, count(*) // {_BATCH} AS batches_per_epoch, (count(*) // {_BATCH}) * 2 AS total_steps
FROM documents""")
def d5_total_steps(spark, sf_dir):
    main, _ = _sources(spark, sf_dir)
    return D.total_steps(main, _BATCH, 2)


@register("a10_resume_feed", f"WITH {_FEED} {_FEED_COLUMNS} WHERE step > 10")
def a10_resume_feed(spark, sf_dir):
    """Feed after a checkpoint at step 10 equals the full feed minus steps 0..10."""
    return D.resume_feed(_feed(spark, sf_dir), 10)


# ------------------------------------------------------------------ H*

_K = 5
_UNEQUAL_K = 4
#: Declared size of the feed batches that are balanced (V.lens).
_ITEMS = V.FEED_BATCH

_LENS_SQL = f"""l AS (
  SELECT pos // {_ITEMS} AS batch_id, doc_id, n_tokens FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
           len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::INTEGER AS n_tokens FROM documents)
  WHERE pos // {_ITEMS} < (SELECT count(*) FROM documents) // {_ITEMS})"""


def _lens(spark, sf_dir):
    return V.lens(spark, sf_dir)


def _balanced(spark, sf_dir, k=_K, **kw):
    return H.balance(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", k, max_items=_ITEMS, **kw)


def _balance_facts(assign, k, equal):
    """Per batch what any correct balance has: all items once, k parts, equal
    sizes where asked for, the tokens of the batch, and a spread of part sums that
    no single item exceeds (differencing guarantees it)."""
    parts = assign.groupBy("batch_id", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d"),
                                                   F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("m"))
    return parts.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_rows"), F.sum("d").alias("n_items"), F.sum("s").alias("n_tokens"),
        (F.max("s") - F.min("s") <= F.max("m")).alias("spread_ok"),
        ((F.min("n") == F.max("n")) if equal else (F.min("n") > 0)).alias("sizes_ok"))


def _facts_sql(n_parts: str) -> str:
    return f"""WITH {_LENS_SQL}
SELECT batch_id, {n_parts} AS n_parts, count(*) AS n_rows, count(DISTINCT doc_id) AS n_items, sum(n_tokens)::BIGINT AS n_tokens,
       true AS spread_ok, true AS sizes_ok FROM l GROUP BY batch_id"""


@register("h1_balance_kk")
def h1_balance_kk(spark, sf_dir):
    """The assignment itself; its facts are compared in h1_balance_facts."""
    return _balanced(spark, sf_dir).select("batch_id", "doc_id", "part")


@register("h1_balance_facts", _facts_sql(f"{_K}::BIGINT"))
def h1_balance_facts(spark, sf_dir):
    return _balance_facts(_balanced(spark, sf_dir), _K, True)


@register("h2_balance_unequal")
def h2_balance_unequal(spark, sf_dir):
    return _balanced(spark, sf_dir, _UNEQUAL_K, equal_size=False).select("batch_id", "doc_id", "part")


@register("h2_balance_unequal_facts", _facts_sql(f"{_UNEQUAL_K}::BIGINT"))
def h2_balance_unequal_facts(spark, sf_dir):
    return _balance_facts(_balanced(spark, sf_dir, _UNEQUAL_K, equal_size=False), _UNEQUAL_K, False)


def _whole(spark, sf_dir):
    """Every document as an item of one batch."""
    words = F.size(T.py_split("text"))
    return V.table(spark, sf_dir, "documents").select(F.lit(0).alias("batch_id"), "doc_id", words.alias("n_tokens"))


_WHOLE_SQL = """
SELECT 0 AS batch_id, {k}::BIGINT AS n_parts, count(*) AS n_rows, count(DISTINCT doc_id) AS n_items,
       sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')))::BIGINT AS n_tokens, true AS spread_ok, true AS sizes_ok
FROM documents"""


@register("h1_balance_hierarchical", _WHOLE_SQL.format(k=_K))
def h1_balance_hierarchical(spark, sf_dir):
    """All documents as one batch, without an item limit: the facts of any correct
    assignment (equal sizes where the number of documents allows)."""
    return _balance_facts(H.hierarchical(_whole(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _K), _K, False)


@register("h2_balance_hierarchical", _WHOLE_SQL.format(k=_UNEQUAL_K))
def h2_balance_hierarchical(spark, sf_dir):
    return _balance_facts(H.hierarchical(_whole(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _UNEQUAL_K, equal_size=False), _UNEQUAL_K, False)


def _schedule_sql(equal: bool) -> str:
    """List scheduling as a recursion over the items' places in their batch."""
    key = f"list_transform(range(1, {_K + 1}), lambda j: {'held[j] * 1000000000000 + ' if equal else ''}w[j])"
    return f"""WITH RECURSIVE {_LENS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS i FROM l),
g AS (
  SELECT DISTINCT batch_id, 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::BIGINT AS p,
         list_transform(range({_K}), lambda j: 0::BIGINT) AS held, list_transform(range({_K}), lambda j: 0::BIGINT) AS w FROM o
  UNION ALL
  SELECT batch_id, i, doc_id, p, list_transform(held, lambda x, j: x + CASE WHEN j = p THEN 1 ELSE 0 END),
         list_transform(w, lambda x, j: x + CASE WHEN j = p THEN n_tokens ELSE 0 END)
  FROM (SELECT o.batch_id, o.i, o.doc_id, o.n_tokens, held, w, list_position({key}, list_min({key}))::BIGINT AS p
        FROM g JOIN o ON o.batch_id = g.batch_id AND o.i = g.i + 1))
SELECT batch_id, doc_id, (p - 1)::INTEGER AS part FROM g WHERE i > 0"""


@register("h3_greedy_balance", _schedule_sql(True))
def h3_greedy_balance(spark, sf_dir):
    return _balanced(spark, sf_dir, method="list").select("batch_id", "doc_id", "part")


@register("h3_greedy_unequal", _schedule_sql(False))
def h3_greedy_unequal(spark, sf_dir):
    return _balanced(spark, sf_dir, method="list", equal_size=False).select("batch_id", "doc_id", "part")


@register("h4_check_partitions", f"""WITH {_LENS_SQL}
SELECT batch_id, {_K}::BIGINT AS n_parts, count(*) // {_K} AS min_part_size, count(*) AS n_rows,
       count(DISTINCT doc_id) AS n_items, true AS valid FROM l GROUP BY batch_id""")
def h4_check_partitions(spark, sf_dir):
    return H.check_partitions(_balanced(spark, sf_dir), "batch_id", "doc_id", _K)


_BEFORE_SQL = f"""{_LENS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) - 1 AS rk,
             count(*) OVER (PARTITION BY batch_id) AS n FROM l),
c AS (SELECT batch_id, rk // greatest(n // {_K}, 1) AS ch, sum(n_tokens) AS s FROM r GROUP BY ALL),
t AS (SELECT batch_id, sum(n_tokens) / {_K}.0 AS mean, max(n_tokens) AS longest FROM l GROUP BY batch_id)"""


@register("h5_unbalance_before", f"""WITH {_BEFORE_SQL}
SELECT c.batch_id, min(s)::BIGINT AS min_before, max(s)::BIGINT AS max_before, (max(s) - min(s))::BIGINT AS diff_before,
       {Q.r6('any_value(t.mean)')} AS mean FROM c JOIN t USING (batch_id) GROUP BY c.batch_id""")
def h5_unbalance_before(spark, sf_dir):
    rep = H.unbalance_report(_balanced(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _K)
    return finish(rep.select("batch_id", "min_before", "max_before", "diff_before", "mean"))


_SNAKE_SQL = f"""s AS (
  SELECT *, CASE WHEN (rk // {_K}) % 2 = 0 THEN rk % {_K} ELSE {_K} - 1 - rk % {_K} END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n_tokens DESC, doc_id) - 1 AS rk FROM l))"""


@register("h5_unbalance_report", f"""WITH {_BEFORE_SQL}, {_SNAKE_SQL},
p AS (SELECT batch_id, part, sum(n_tokens) AS s FROM s GROUP BY ALL),
a AS (SELECT batch_id, min(s) AS lo, max(s) AS hi FROM p GROUP BY batch_id)
SELECT c.batch_id, min(c.s)::BIGINT AS min_before, max(c.s)::BIGINT AS max_before, (max(c.s) - min(c.s))::BIGINT AS diff_before,
       any_value(a.lo)::BIGINT AS min_after, any_value(a.hi)::BIGINT AS max_after, any_value(a.hi - a.lo)::BIGINT AS diff_after,
       {Q.r6('any_value(t.mean)')} AS mean
FROM c JOIN t USING (batch_id) JOIN a USING (batch_id) GROUP BY c.batch_id""")
def h5_unbalance_report(spark, sf_dir):
    """All columns of the report, over the serpentine assignment."""
    assign = H.serpentine(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _K)
    return finish(H.unbalance_report(assign, "batch_id", "doc_id", "n_tokens", _K))


_LIMIT = 25000


@register("h6_micro_batches")
def h6_micro_batches(spark, sf_dir):
    return H.micro_batches(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _LIMIT, max_items=_ITEMS) \
        .select("batch_id", "doc_id", "part")


@register("h6_micro_batch_facts", _facts_sql(f"ceil(sum(n_tokens) / {_LIMIT}.0)::BIGINT"))
def h6_micro_batch_facts(spark, sf_dir):
    assign = H.micro_batches(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _LIMIT, max_items=_ITEMS)
    return _balance_facts(assign, None, False)


@register("h7_reverse_index", """
SELECT (SELECT count(*) FROM documents) - 1 - doc_id AS row_id, doc_id AS new_pos FROM documents""")
def h7_reverse_index(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    n = d.count()
    perm = d.select("row_id", (F.lit(n - 1) - F.col("row_id")).alias("new_pos"))
    return H.reverse_index(perm)


@register("h8_balance_batch", f"""WITH {_BEFORE_SQL},
b AS (SELECT batch_id, max(s) - min(s) AS d FROM c GROUP BY batch_id)
SELECT l.batch_id, count(*) AS n_rows, count(*) AS n_positions, 0::BIGINT AS first_position, count(*) - 1 AS last_position, true AS in_part_order,
       any_value(b.d)::BIGINT AS diff_before, true AS balanced
FROM l JOIN b USING (batch_id) GROUP BY l.batch_id""")
def h8_balance_batch(spark, sf_dir):
    """The reordered rows: positions are a permutation, parts follow each other,
    and the part sums differ by at most the longest item."""
    ordered, report = H.balance_batch(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _K, max_items=_ITEMS)
    facts = ordered.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("new_pos").alias("n_positions"), F.min("new_pos").alias("first_position"),
        F.max("new_pos").alias("last_position"), F.max("n_tokens").alias("longest"),
        F.min(F.floor(F.col("new_pos") / (_ITEMS // _K)) == F.col("part")).alias("in_part_order"))
    return facts.join(report, "batch_id").select(
        "batch_id", "n_rows", "n_positions", "first_position", "last_position", "in_part_order", "diff_before",
        (F.col("diff_after") <= F.col("longest")).alias("balanced"))


@register("h9_serpentine_balance", f"""WITH {_LENS_SQL}, {_SNAKE_SQL} SELECT batch_id, doc_id, part::INTEGER AS part FROM s""")
def h9_serpentine_balance(spark, sf_dir):
    return H.serpentine(_lens(spark, sf_dir), "batch_id", "doc_id", "n_tokens", _K).select("batch_id", "doc_id", "part")


# ------------------------------------------------------------------ A*


@register("a1_read_examples", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 10 = 3")
def a1_read_examples(spark, sf_dir):
    """``path@test`` of a folder with one sub-folder per split."""
    path = IO.scratch_path(spark, f"splits-{uuid.uuid4().hex}")
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    d.where("doc_id % 10 = 3").write.parquet(f"{path}/test")
    d.where("doc_id % 10 <> 3").write.parquet(f"{path}/train")
    return IO.read_examples(spark, f"{path}@test")


@register("a1_read_split_column", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 3")
def a1_read_split_column(spark, sf_dir):
    """The default split of a table with a ``split`` column."""
    path = IO.scratch_path(spark, f"splits-{uuid.uuid4().hex}")
    d = V.table(spark, sf_dir, "documents")
    d.select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 3, "test").otherwise("train").alias("split")).write.parquet(path)
    return IO.read_examples(spark, path)


@register("a3_export_read_jsonl", "SELECT item_id, text FROM benchmark")
def a3_export_read_jsonl(spark, sf_dir):
    """A3 then A2: export the benchmark set as JSON lines and read it back."""
    path = IO.scratch_path(spark, f"jsonl-{uuid.uuid4().hex}")
    IO.export_jsonl(V.table(spark, sf_dir, "benchmark"), path)
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("item_id", Ty.LongType()), Ty.StructField("text", Ty.StringType())])
    return IO.read_json_examples(spark, path + "/*.json", schema)


@register("a5_append_read_predictions", f"""WITH {Q.QA_PAIRS}
SELECT dataset, pred, answers[1] AS answer, length::BIGINT AS length, pred AS raw_pred FROM qa_pairs""")
def a5_append_read_predictions(spark, sf_dir):
    """A5 then A4: append prediction lines per dataset, read them back."""
    qa = V.qa_pairs(spark, sf_dir).select("dataset", "pred", "answers", F.col("length").cast("long").alias("length"),
                                          F.lit(None).cast("array<string>").alias("all_classes"),
                                          F.col("pred").alias("raw_pred"))
    path = IO.scratch_path(spark, f"pred-{uuid.uuid4().hex}")
    IO.append_predictions(qa, path)
    back = IO.read_predictions(spark, path)
    return back.select("dataset", "pred", F.col("answers")[0].alias("answer"), "length", "raw_pred")


@register("a7_save_load_batch", """
SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, 7 AS step, 'orders' AS origin FROM orders""")
def a7_save_load_batch(spark, sf_dir):
    """A batch with its constants, saved and loaded."""
    from trellis.operators.batch import Batch

    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_totalprice")
    path = IO.scratch_path(spark, f"batch-{uuid.uuid4().hex}")
    Batch(o, {"step": 7, "origin": "orders"}).save(path)
    back = Batch.load(spark, path)
    return back.rows.select("*", F.lit(back.meta["step"]).alias("step"), F.lit(back.meta["origin"]).alias("origin"))


@register("a8_metric_table", f"""WITH {Q.STEP_LOG}
SELECT step::INTEGER AS step, run || '/kl' AS name, {Q.r6('kl')} AS value FROM step_log
UNION ALL SELECT step::INTEGER, run || '/n', n::DOUBLE FROM step_log""")
def a8_metric_table(spark, sf_dir):
    """The table backend: metrics of a stream's micro-batches, appended through
    ``foreachBatch`` and read back."""
    from trellis.operators.metrics import to_long
    from trellis.streaming.streams import log_stream

    long = to_long(V.step_log(spark, sf_dir), ["run", "step"], {"kl": "kl", "n": "n"})
    source = IO.scratch_path(spark, f"metrics-in-{uuid.uuid4().hex}")
    long.select("step", F.concat_ws("/", "run", "name").alias("name"), "value").write.parquet(source)
    return finish(log_stream(spark, source).select("step", "name", "value"))


def _samples_sql():
    from trellis.plans.reward_queries import _ACC, _RESP, _SPAN_SCORE

    picked = ", ".join(f"max(CASE WHEN i = {i} THEN {c} END) AS {c}_{i}" for i in (1, 2, 3) for c in ("input", "output", "score"))
    return _RESP + f""",
sc AS (SELECT doc_id, ground_truth AS input, response AS output,
              {Q.r6(f"0.7 * ({_ACC}) + 0.1 * ({Q.evidence_format_sql('response')}) + 0.2 * ({_SPAN_SCORE})")} AS score FROM responses),
o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', input)), doc_id) AS i FROM sc)
SELECT {picked} FROM o WHERE i <= 3"""


@register("a9_validation_samples_exact", _samples_sql())
def a9_validation_samples_exact(spark, sf_dir):
    """The sample over the verbatim reward, which SQL can check."""
    from trellis.operators import rewards as OR
    from trellis.operators.metrics import validation_samples

    r = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=False)
    r = finish(r.select(F.col("ground_truth").alias("input"), F.col("response").alias("output"), F.col("reward").alias("score"), "doc_id"))
    return validation_samples(r, 3, key="doc_id")


@register("a9_validation_samples")
def a9_validation_samples(spark, sf_dir):
    """Deterministic sample of (input, output, score) rows, one wide row."""
    from trellis.operators import rewards as OR
    from trellis.operators.metrics import validation_samples

    r = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=True)
    r = r.select(F.col("ground_truth").alias("input"), F.col("response").alias("output"),
                 F.col("reward").alias("score"), "doc_id")
    return validation_samples(r, 3, key="doc_id")


def _f16_sql_scores():
    from trellis.plans.evaluation_queries import _DOC_BEST

    return _DOC_BEST + """
SELECT dataset, round(100.0 * avg(score), 2) AS score FROM scored GROUP BY dataset"""


@register("a6_write_report", _f16_sql_scores())
def a6_write_report(spark, sf_dir):
    """Write the ``{dataset: score}`` report and read it back."""
    from trellis.plans.evaluation_queries import _doc_scored
    from trellis.operators.evaluate import dataset_score

    scores = dataset_score(_doc_scored(spark, sf_dir)).select("dataset", "score")
    path = IO.scratch_path(spark, f"report-{uuid.uuid4().hex}")
    IO.write_report(scores, path)
    back = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return finish(back.select(F.explode("m").alias("dataset", "score")))
