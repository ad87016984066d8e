"""Registered queries for batch algebra (B*) and prompt / token-array operators (C*)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from trellis.functions import arrays as AR
from trellis.operators import batch as B
from trellis.operators import prompts as P
from trellis.operators.evaluate import DATASET_METRIC
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.sources import views as V


def _orders(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.withColumnRenamed("o_orderkey", B.ROW_ID)


# ------------------------------------------------------------------ B*

@register("b0_assign_row_ids", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                   l_discount, l_tax, l_shipdate) - 1 AS row_id
FROM lineitem""")
def b0_assign_row_ids(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_shipdate"]
    out = B.assign_row_ids(li, order)
    return finish(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "row_id"))


@register("b2_check_consistency", """
SELECT doc_id AS row_id, len(string_split(text, chr(10)))::INTEGER AS n_lines, len(string_split(text, ' '))::INTEGER AS n_words
FROM documents WHERE len(string_split(text, chr(10))) <> len(string_split(text, ' '))""")
def b2_check_consistency(spark, sf_dir):
    """Rows whose two arrays differ in length: here lines and words, which agree
    for few documents."""
    d = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.split("text", "\n").alias("lines"), F.split("text", " ").alias("words"))
    return B.check_consistency(d, ["lines", "words"]).select("row_id", F.size("lines").alias("n_lines"), F.size("words").alias("n_words"))


@register("b3_select", "SELECT o_orderkey AS row_id, o_custkey, o_totalprice FROM orders")
def b3_select(spark, sf_dir):
    return B.select(_orders(spark, sf_dir), ["o_custkey", "o_totalprice"])


@register("b4_pop", "SELECT o_orderkey AS row_id, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def b4_pop(spark, sf_dir):
    taken, rest = B.pop(_orders(spark, sf_dir), ["o_custkey", "o_totalprice"])
    return rest


@register("b5_rename", "SELECT o_orderkey AS row_id, o_custkey AS customer, o_totalprice AS price FROM orders")
def b5_rename(spark, sf_dir):
    o = B.select(_orders(spark, sf_dir), ["o_custkey", "o_totalprice"])
    return B.rename(o, ["o_custkey", "o_totalprice"], ["customer", "price"])


@register("b6_union", """
SELECT o_orderkey AS row_id, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def b6_union(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return B.union(o.select("row_id", "o_custkey", "o_totalprice"), o.select("row_id", "o_custkey", "o_orderstatus"))


@register("b6_union_tables", """
SELECT o_orderkey AS row_id, o_custkey, o_totalprice, n_items, items_price FROM orders
JOIN (SELECT l_orderkey, count(*) AS n_items, round(sum(l_extendedprice), 2) AS items_price FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice, 0, 0.0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def b6_union_tables(spark, sf_dir):
    """Two different tables with one shared column, and batch constants that agree."""
    o = _orders(spark, sf_dir).select("row_id", "o_custkey", "o_totalprice")
    items = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("items_price"))
    side = o.select("row_id", "o_custkey").join(items, "row_id", "left").na.fill({"n_items": 0, "items_price": 0.0})
    return finish(B.Batch(o, {"step": 1}).union(B.Batch(side, {"step": 1, "epoch": 0})).rows)


#: Buckets of a stored batch; a cluster takes a few for each of its cores.
_BUCKETS = 16


@register("b6_union_bucketed", """
SELECT o_orderkey AS row_id, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def b6_union_bucketed(spark, sf_dir):
    """Two stored batches, merged without a shuffle."""
    o = _orders(spark, sf_dir)
    a, b = (B.store_bucketed(o.select("row_id", "o_custkey", c), f"batch_{uuid.uuid4().hex}", _BUCKETS) for c in ("o_totalprice", "o_orderstatus"))
    return B.union(a, b)


@register("b10_reorder_bucketed", """
SELECT (SELECT count(*) FROM orders) - 1 - o_orderkey AS row_id, o_totalprice FROM orders""")
def b10_reorder_bucketed(spark, sf_dir):
    """A stored batch and a stored permutation (here: from back to front)."""
    o = _orders(spark, sf_dir).select("row_id", "o_totalprice")
    perm = o.select("row_id", (F.lit(o.count() - 1) - F.col("row_id")).alias("new_pos"))
    a, p = (B.store_bucketed(x, f"batch_{uuid.uuid4().hex}", _BUCKETS) for x in (o, perm))
    return B.reorder(a, p)


@register("b7_concat", """
SELECT c_custkey AS row_id, c_name AS name FROM customer
UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), s_name FROM supplier""")
def b7_concat(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"))
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"))
    return B.concat([c, s])


@register("b8_chunk", "SELECT o_orderkey AS row_id, o_orderkey // ((SELECT count(*) FROM orders) // 5) AS chunk_id FROM orders")
def b8_chunk(spark, sf_dir):
    return B.chunk(_orders(spark, sf_dir), 5).select("row_id", "chunk_id")


@register("b9_split", "SELECT o_orderkey AS row_id, o_orderkey // 1000 AS chunk_id FROM orders")
def b9_split(spark, sf_dir):
    return B.split(_orders(spark, sf_dir), 1000).select("row_id", "chunk_id")


@register("b10_reorder", """
SELECT (SELECT count(*) FROM orders) - 1 - o_orderkey AS row_id, o_custkey FROM orders""")
def b10_reorder(spark, sf_dir):
    o = _orders(spark, sf_dir)
    n = o.count()
    perm = o.select("row_id", (F.lit(n - 1) - F.col("row_id")).alias("new_pos"))
    return B.reorder(o.select("row_id", "o_custkey"), perm)


@register("b11_repeat_interleave", """
SELECT n_nationkey * 3 + r AS row_id, n_name FROM nation, range(3) t(r)""")
def b11_repeat_interleave(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name")
    return B.repeat(n, 3, interleave=True)


@register("b12_repeat_blocked", """
SELECT r * (SELECT count(*) FROM nation) + n_nationkey AS row_id, n_name FROM nation, range(3) t(r)""")
def b12_repeat_blocked(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name")
    return B.repeat(n, 3, interleave=False)


@register("b13_pad_to_divisor", """
WITH n AS (SELECT count(*) AS n FROM region), p AS (SELECT (8 - n % 8) % 8 AS pad, n FROM n)
SELECT r_regionkey::BIGINT + j * n AS row_id, r_name FROM region, p, range(0, 3) t(j)
WHERE r_regionkey + j * n < n + pad""")
def b13_pad_to_divisor(spark, sf_dir):
    r = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("row_id"), "r_name")
    out, _ = B.pad_to_divisor(r, 8)
    return out


@register("b14_unpad", """
SELECT r_regionkey::BIGINT AS row_id, r_name FROM region""")
def b14_unpad(spark, sf_dir):
    r = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("row_id"), "r_name")
    padded, pad = B.pad_to_divisor(r, 8)
    return B.unpad(padded, pad)


@register("b15_fold_batch_dim", """
SELECT o_orderkey AS row_id, o_orderkey // ((SELECT count(*) FROM orders) // 3) AS fold,
       o_orderkey % ((SELECT count(*) FROM orders) // 3) AS inner FROM orders""")
def b15_fold_batch_dim(spark, sf_dir):
    return B.fold_batch_dim(_orders(spark, sf_dir).select("row_id"), 3)


@register("b16_minibatches", """
SELECT o_orderkey AS row_id, e::INTEGER AS epoch, o_orderkey // 500 AS minibatch FROM orders, range(2) t(e)""")
def b16_minibatches(spark, sf_dir):
    return B.minibatches(_orders(spark, sf_dir).select("row_id"), 500, 2)


@register("b16_minibatches_shuffled", """
SELECT row_id, epoch, (row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', '7', epoch, row_id)), row_id) - 1) // 500 AS minibatch
FROM (SELECT o_orderkey AS row_id, e::INTEGER AS epoch FROM orders, range(2) t(e))""")
def b16_minibatches_shuffled(spark, sf_dir):
    """Seeded per-epoch order."""
    return B.minibatches(_orders(spark, sf_dir).select("row_id"), 500, 2, seed=7)


@register("b17_take", "SELECT o_orderkey AS row_id, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def b17_take(spark, sf_dir):
    return B.take(_orders(spark, sf_dir).select("row_id", "o_totalprice"), 100, 200)


@register("b18_size_report", f"""
SELECT {Q.r6("count(*) * 8.0 * 3 / 1073741824")} AS batch_gb,
       {Q.r6("sum(strlen(o_orderstatus) + strlen(o_orderpriority))::DOUBLE / 1073741824")} AS non_tensor_gb
FROM orders""")
def b18_size_report(spark, sf_dir):
    o = _orders(spark, sf_dir).select("row_id", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                                      F.lit(0).cast("long").alias("pad"))
    return finish(B.size_report(o.drop("pad")))


_COLLATE = 64


@register("b19_collate", f"""WITH {Q.ARRAYS},
x AS (SELECT row_number() OVER (ORDER BY user_id, piece) - 1 AS i, len(ids)::INTEGER AS n FROM arrays)
SELECT i // {_COLLATE} AS batch, list(n ORDER BY i) AS n FROM x GROUP BY batch""")
def b19_collate(spark, sf_dir):
    """Batches of a declared number of rows."""
    a = V.arrays(spark, sf_dir).select("user_id", "piece", F.size("ids").alias("n"))
    a = B.assign_row_ids(a, ["user_id", "piece"]).withColumn("batch", F.floor(F.col("row_id") / _COLLATE))
    return B.collate(a, "batch", ["n"], max_rows=_COLLATE)


@register("b20_append_reduce", f"""WITH {Q.STEP_LOG}
SELECT step, {Q.r6('avg(kl)')} AS kl_mean FROM step_log GROUP BY step""")
def b20_append_reduce(spark, sf_dir):
    sl = V.step_log(spark, sf_dir)
    from trellis.operators.metrics import reduce_metrics, to_long

    long = to_long(sl, ["step"], {"kl": "kl"})
    return finish(reduce_metrics(long, ["step"]).withColumnRenamed("value", "kl_mean"))


@register("b21_map_chunks", "SELECT o_orderkey AS row_id, o_totalprice * 2 AS doubled FROM orders")
def b21_map_chunks(spark, sf_dir):
    import pyarrow.compute as pc

    def fn(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], ["row_id", "doubled"])

    o = _orders(spark, sf_dir).select("row_id", "o_totalprice")
    return finish(B.map_chunks(o, fn, "row_id long, doubled double"))


@register("b21_chunk_function", f"""
SELECT o_custkey AS chunk, o_orderkey AS row_id, {Q.r6('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)')} AS running,
       false AS last FROM orders
UNION ALL SELECT o_custkey, count(*), {Q.r6('sum(o_totalprice)')}, true FROM orders GROUP BY o_custkey""")
def b21_chunk_function(spark, sf_dir):
    """The table function from SQL: running totals inside a customer's orders, and a
    closing row (count and total) a chunk."""
    def step(state, row):
        n, total = state[0] + 1, state[1] + row.o_totalprice
        return (n, total, row.o_custkey), [(row.o_custkey, row.o_orderkey, total, False)]

    name, view = (f"{x}_{uuid.uuid4().hex}" for x in ("running_totals", "orders_in_chunks"))
    B.register_chunk_function(spark, name, lambda: (0, 0.0, None), step, "chunk long, row_id long, running double, last boolean",
                              lambda state: [(state[2], state[0], state[1], True)])
    V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").createOrReplaceTempView(view)
    return finish(spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY o_custkey ORDER BY o_orderkey)"))


@register("b22_broadcast_args", """
SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def b22_broadcast_args(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = V.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return B.broadcast_args(c, n, ["n_nationkey"]).select("c_custkey", "n_name")


@register("b23_gather_slice", "SELECT o_orderkey AS row_id, o_orderkey // ((SELECT count(*) FROM orders) // 4) AS rank FROM orders")
def b23_gather_slice(spark, sf_dir):
    return B.gather_slice(_orders(spark, sf_dir).select("row_id"), 4)


@register("b24_assign_uid", """
SELECT o_orderkey AS row_id, sha256(strftime(o_orderdate, '%Y') || '|' || o_orderkey::VARCHAR) AS uid FROM orders""")
def b24_assign_uid(spark, sf_dir):
    o = _orders(spark, sf_dir).select("row_id", F.date_format("o_orderdate", "yyyy").alias("step"))
    return B.assign_uid(o).select("row_id", "uid")


@register("b25_strided_shard", "SELECT o_orderkey AS row_id, o_orderkey % 8 AS shard FROM orders")
def b25_strided_shard(spark, sf_dir):
    return B.strided_shard(_orders(spark, sf_dir).select("row_id"), 8)


# ------------------------------------------------------------------ C*

_ARR = f"WITH {Q.ARRAYS}"


@register("c1_chat_messages", """
WITH sys AS (SELECT conv_id, text AS system FROM conversations WHERE role = 'system'),
u AS (SELECT c.conv_id, c.turn, c.text, s.system FROM conversations c LEFT JOIN sys s USING (conv_id) WHERE c.role = 'user')
SELECT conv_id, turn, CASE WHEN coalesce(system, '') <> '' THEN 2 ELSE 1 END AS n_messages,
       CASE WHEN coalesce(system, '') <> '' THEN 'system:' || system || chr(10) ELSE '' END || 'user:' || text AS rendered
FROM u""")
def c1_chat_messages(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    sys = c.filter(F.col("role") == "system").select("conv_id", F.col("text").alias("system"))
    u = c.filter(F.col("role") == "user").join(sys, "conv_id", "left")
    m = P.chat_messages("text", F.col("system"))
    return u.select("conv_id", "turn", F.size(m).alias("n_messages"),
                    F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
                    .alias("rendered"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _chat_sql() -> str:
    wrapped = {name: (before, after) for name, before, after in P.WRAPPERS}
    cols = [f"{_sql_text(wrapped[k][0])} || text || {_sql_text(wrapped[k][1])} AS {k}" for k in wrapped]
    nl = "chr(10)"
    cols.append(f"""'<|im_start|>system' || {nl} || {_sql_text(P.SYSTEM_TEXT['Qwen2.5'])} || '<|im_end|>' || {nl} || '<|im_start|>user' || {nl}
      || text || '<|im_end|>' || {nl} || '<|im_start|>assistant' || {nl} AS qwen""")
    cols.append(f"""'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || {nl} || {nl} || {_sql_text(P.SYSTEM_TEXT['Llama'])}
      || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || {nl} || {nl} || text
      || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {nl} || {nl} AS llama3""")
    tuned = f"{P.SYSTEM_TEXT['Qwen2.5']} {P.EVIDENCE_INSTRUCTION}"
    cols.append(f"""'<|im_start|>system' || {nl} || {_sql_text(tuned)} || '<|im_end|>' || {nl} || '<|im_start|>user' || {nl}
      || text || '<|im_end|>' || {nl} || '<|im_start|>assistant' || {nl} AS tuned""")
    return f"SELECT conv_id, turn, {', '.join(cols)}, text AS other FROM conversations WHERE role = 'user'"


_MODELS = {"chatglm3": "chatglm3-6b-32k", "chatglm": "chatglm2-6b", "longchat": "longchat-v1.5-7b-32k", "vicuna": "vicuna-v1.5-7b-16k",
           "llama2": "llama2-7b-chat-4k", "xgen": "xgen-7b-8k", "internlm": "internlm-7b-8k", "qwen": "Qwen2.5-7B-Instruct",
           "llama3": "Meta-Llama-3.1-8B-Instruct", "tuned": "Qwen2.5-7B-Instruct-tuned", "other": "some-other-model"}


@register("c2_render_chat", _chat_sql())
def c2_render_chat(spark, sf_dir):
    """Every chat family, a tuned model, and a model of no known family."""
    c = V.table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", *[P.render_chat("text", m, tuned_marker="tuned").alias(k) for k, m in _MODELS.items()])


_DATASETS_SQL = "[" + ", ".join("'" + n + "'" for n in DATASET_METRIC) + "]"


def _eval_items(spark, sf_dir):
    names = list(DATASET_METRIC)
    d = V.table(spark, sf_dir, "documents")
    ds = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int"))
    return d.select("doc_id", ds.alias("dataset"), F.col("text").alias("context"),
                    F.concat(F.lit("Which source is {input} "), F.col("source"), F.lit("?")).alias("input"))


def _fill_sql():
    from trellis.sources.eval_config import DATASET_PROMPT

    cases = []
    for name, tpl in DATASET_PROMPT.items():
        pieces, last = [], 0
        for m in re.finditer(r"\{(context|input)\}", tpl):
            pieces.append(_sql_lit(tpl[last:m.start()]))
            pieces.append("context" if m.group(1) == "context" else "input")
            last = m.end()
        pieces.append(_sql_lit(tpl[last:]))
        cases.append(f"WHEN '{name}' THEN " + " || ".join(pieces))
    return f"""
WITH items AS (SELECT doc_id, {_DATASETS_SQL}[doc_id % {len(DATASET_METRIC)} + 1] AS dataset, text AS context,
                      'Which source is {{input}} ' || source || '?' AS input FROM documents)
SELECT doc_id, dataset, CASE dataset {' '.join(cases)} END AS prompt FROM items"""


def _sql_lit(s: str) -> str:
    parts = s.split("\n")
    out = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
    return f"({out})"


@register("c3_fill_template", _fill_sql())
def c3_fill_template(spark, sf_dir):
    from trellis.sources.eval_config import DATASET_PROMPT

    items = _eval_items(spark, sf_dir)
    cols = {"context": F.col("context"), "input": F.col("input")}
    return items.select("doc_id", "dataset", P.fill_by_dataset("dataset", DATASET_PROMPT, cols).alias("prompt"))


@register("c4_middle_truncate", _ARR + """
SELECT user_id, piece, CASE WHEN len(ids) > 16 THEN list_concat(ids[1:8], ids[-8:]) ELSE ids END AS ids FROM arrays""")
def c4_middle_truncate(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    return a.select("user_id", "piece", AR.middle_truncate("ids", 16).alias("ids"))


@register("c5_needs_chat", f"""
WITH items AS (SELECT doc_id, {_DATASETS_SQL}[doc_id % {len(DATASET_METRIC)} + 1] AS dataset FROM documents)
SELECT doc_id, dataset, dataset NOT IN ('trec', 'triviaqa', 'samsum', 'lsht', 'lcc', 'repobench-p') AS chat FROM items""")
def c5_needs_chat(spark, sf_dir):
    from trellis.operators.evaluate import dataset_config

    items = _eval_items(spark, sf_dir).select("doc_id", "dataset")
    cfg = F.broadcast(dataset_config(spark).select("dataset", "chat"))
    return items.join(cfg, "dataset", "left").select("doc_id", "dataset", "chat")


@register("c6_pad_or_truncate", _ARR + f"""
SELECT user_id, piece,
  CASE WHEN len(ids) < 64 THEN list_concat({Q.zeros('64 - len(ids)')}, ids) WHEN len(ids) > 64 THEN ids[1:64] ELSE ids END AS right_trunc,
  CASE WHEN len(ids) < 64 THEN list_concat({Q.zeros('64 - len(ids)')}, ids) WHEN len(ids) > 64 THEN ids[-64:] ELSE ids END AS left_trunc
FROM arrays""")
def c6_pad_or_truncate(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    return a.select("user_id", "piece", AR.pad_or_truncate("ids", 64, 0, True, "right").alias("right_trunc"),
                    AR.pad_or_truncate("ids", 64, 0, True, "left").alias("left_trunc"))


@register("c7_position_ids", _ARR + f""",
m AS (SELECT user_id, piece, {Q.eos_mask_sql('ids', 4)} AS mask FROM arrays)
SELECT user_id, piece, {Q.position_ids_sql('mask')} AS position_ids FROM m""")
def c7_position_ids(spark, sf_dir):
    a = V.arrays(spark, sf_dir).withColumn("mask", AR.eos_mask("ids", V.EOS_ID))
    return a.select("user_id", "piece", AR.position_ids("mask").alias("position_ids"))


@register("c7_token_positions", f"""WITH {Q.TOKENS}
SELECT user_id, piece, pos, greatest(sum(mask) OVER (PARTITION BY user_id, piece ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS position_id
FROM tokens""")
def c7_token_positions(spark, sf_dir):
    """C7 at token grain."""
    return P.with_position_ids(V.tokens(spark, sf_dir), ["user_id", "piece"]).select("user_id", "piece", "pos", "position_id")


@register("c8_token_eos_mask", f"""WITH {Q.TOKENS} SELECT user_id, piece, pos, mask FROM tokens""")
def c8_token_eos_mask(spark, sf_dir):
    """C8 at token grain."""
    return P.with_eos_mask(V.seqs(spark, sf_dir), ["user_id", "piece"], "is_eos").select("user_id", "piece", "pos", "mask")


@register("c8_eos_mask", _ARR + f"""
SELECT user_id, piece, {Q.eos_mask_sql('ids', 4)} AS mask FROM arrays""")
def c8_eos_mask(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    return a.select("user_id", "piece", AR.eos_mask("ids", V.EOS_ID).alias("mask"))


@register("c9_pad_ragged", _ARR + f"""
SELECT user_id, piece, list_concat(ids, {Q.zeros('greatest(greatest((SELECT max(len(ids)) FROM arrays), 16) - len(ids), 0)')}) AS padded
FROM arrays""")
def c9_pad_ragged(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    width = F.greatest(a.select(F.max(F.size("ids"))).scalar(), F.lit(16))
    return a.select("user_id", "piece", AR.pad_ragged("ids", width, 0).alias("padded"))


_PW, _RW = 8, 120


def _rollouts(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    p = F.slice("ids", 1, _PW)
    pm = F.transform(p, lambda x: F.lit(1).cast("long"))
    a = a.select("user_id", "piece",
                 AR.pad_or_truncate(p, _PW, 0, True, "error").alias("prompt_ids"),
                 AR.pad_or_truncate(pm, _PW, 0, True, "error").alias("prompt_mask"),
                 F.slice("ids", _PW + 1, _RW).alias("resp"))
    a = a.withColumn("prompt_pos", AR.position_ids("prompt_mask"))
    return P.assemble_rollout(a, "prompt_ids", "prompt_mask", "prompt_pos", "resp", _RW, V.EOS_ID)


_ROLL_SQL = _ARR + f""",
r0 AS (SELECT user_id, piece, ids[1:{_PW}] AS p, ids[{_PW + 1}:{_PW + _RW}] AS resp FROM arrays),
r1 AS (SELECT user_id, piece, list_concat({Q.zeros(f'{_PW} - len(p)')}, p) AS prompt_ids,
              list_concat({Q.zeros(f'{_PW} - len(p)')}, list_transform(p, lambda x: 1::BIGINT)) AS prompt_mask,
              list_concat(resp, {Q.zeros(f'{_RW} - len(resp)')}) AS responses FROM r0),
r2 AS (SELECT *, {Q.position_ids_sql('prompt_mask')} AS prompt_pos FROM r1),
roll AS (SELECT user_id, piece, prompt_ids, responses, list_concat(prompt_ids, responses) AS input_ids,
                list_concat(prompt_mask, {Q.eos_mask_sql('responses', 4)}) AS attention_mask,
                list_concat(prompt_pos, list_transform(range(1, {_RW + 1}), lambda d: prompt_pos[-1] + d)) AS position_ids
         FROM r2)"""


@register("c10_assemble_rollout", _ROLL_SQL + """
SELECT user_id, piece, input_ids, attention_mask, position_ids FROM roll""")
def c10_assemble_rollout(spark, sf_dir):
    r = _rollouts(spark, sf_dir)
    return r.select("user_id", "piece", "input_ids", "attention_mask", "position_ids")


@register("c11_response_info", _ROLL_SQL + f"""
SELECT user_id, piece, list_sum(attention_mask[1:{_PW}])::DOUBLE AS prompt_length,
       list_sum(attention_mask[-{_RW}:])::DOUBLE AS response_length FROM roll""")
def c11_response_info(spark, sf_dir):
    r = _rollouts(spark, sf_dir)
    return r.select("user_id", "piece",
                    AR.array_sum(AR.prompt_part("attention_mask", _RW)).cast("double").alias("prompt_length"),
                    AR.array_sum(AR.response_part("attention_mask", _RW)).cast("double").alias("response_length"))


@register("c12_valid_slices", _ROLL_SQL + f""",
l AS (SELECT *, list_sum(attention_mask[1:{_PW}]) AS n, list_sum(attention_mask[-{_RW}:]) AS m FROM roll)
SELECT user_id, piece, CASE WHEN n = 0 THEN []::BIGINT[] ELSE prompt_ids[-n:] END AS valid_prompt,
       responses[1:m] AS valid_response FROM l""")
def c12_valid_slices(spark, sf_dir):
    r = _rollouts(spark, sf_dir)
    r = r.withColumn("n", AR.array_sum(AR.prompt_part("attention_mask", _RW)).cast("int")) \
         .withColumn("m", AR.array_sum(AR.response_part("attention_mask", _RW)).cast("int"))
    vp, vr = AR.valid_slices("prompt_ids", "responses", "n", "m")
    return r.select("user_id", "piece", vp.alias("valid_prompt"), vr.alias("valid_response"))


@register("c13_image_placeholder", """
SELECT page_id, replace(html, '<image>', '<|vision_start|><|image_pad|><|vision_end|>') AS prompt FROM pages""")
def c13_image_placeholder(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", P.image_placeholder("html").alias("prompt"))


#: Tokens a pack holds at most, and a sequence.
_BUDGET = 4096
_STRETCH = _BUDGET - V.SEQ_LEN + 1

_PACK_SQL = f"""WITH {Q.TOKENS},
kept AS (SELECT * FROM tokens WHERE mask <> 0),
lens AS (SELECT user_id, piece, count(*) AS seq_len FROM kept GROUP BY ALL),
st AS (SELECT *, coalesce(sum(seq_len) OVER (ORDER BY user_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lens),
pk AS (SELECT *, start // {_STRETCH} AS pack FROM st),
cu AS (SELECT *, start - min(start) OVER (PARTITION BY pack) AS cu_start FROM pk),
packed AS (SELECT s.pack, k.user_id, k.piece, k.pos, k.event_id, s.cu_start,
                  (s.cu_start + row_number() OVER (PARTITION BY k.user_id, k.piece ORDER BY k.pos) - 1)::BIGINT AS packed_pos
           FROM kept k JOIN cu s USING (user_id, piece))"""


def _packed(spark, sf_dir):
    return P.pack_sequences(V.tokens(spark, sf_dir), ["user_id", "piece"], _BUDGET, V.SEQ_LEN)


@register("c14_sequence_packing", _PACK_SQL + """
SELECT pack, user_id, piece, pos, cu_start, packed_pos FROM packed""")
def c14_sequence_packing(spark, sf_dir):
    return _packed(spark, sf_dir).select("pack", "user_id", "piece", "pos", "cu_start", "packed_pos")


@register("c15_next_token_labels", _PACK_SQL + """
SELECT pack, packed_pos, event_id, lead(event_id) OVER (PARTITION BY pack ORDER BY packed_pos) AS label FROM packed""")
def c15_next_token_labels(spark, sf_dir):
    lab = P.next_token_labels(_packed(spark, sf_dir), "pack", "event_id")
    return lab.select("pack", "packed_pos", "event_id", "label")


@register("c14_pack_sizes", _PACK_SQL + f"""
SELECT pack, count(*) AS n_tokens, max(packed_pos) AS last_pos, count(*) <= {_BUDGET} AS within_budget FROM packed GROUP BY pack""")
def c14_pack_sizes(spark, sf_dir):
    """No pack exceeds its budget, and its positions have no gap."""
    return _packed(spark, sf_dir).groupBy("pack").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.max("packed_pos").alias("last_pos"),
        (F.count(F.lit(1)) <= _BUDGET).alias("within_budget"))


@register("c16_response_window", _ARR + f"""
SELECT user_id, piece, list_transform(list_concat(vals, {Q.zeros('128 - len(vals)', 'DOUBLE')})[8:127], lambda x: round(x, 6) + 0.0) AS window
FROM arrays""")
def c16_response_window(spark, sf_dir):
    a = V.arrays(spark, sf_dir)
    full = AR.pad_ragged("vals", 128, 0.0)
    win = AR.response_window(full, 120)
    return a.select("user_id", "piece", F.transform(win, lambda x: F.round(x, 6) + 0.0).alias("window"))


@register("c17_strip_markers", f"""WITH {Q.RESPONSES}
SELECT doc_id, replace({Q.py_strip('response')}, 'Assistant:', '') AS xgen,
       split_part(response, '<eoa>', 1) AS internlm,
       CASE WHEN strpos(response, 'Answer:') > 0 THEN {Q.py_strip("substr(response, strpos(response, 'Answer:') + 7)")}
            ELSE response END AS tuned
FROM responses""")
def c17_strip_markers(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return r.select("doc_id", P.strip_markers("response", "xgen-7b-8k").alias("xgen"),
                    P.strip_markers("response", "internlm-7b-8k").alias("internlm"),
                    P.strip_markers("response", "Qwen2.5-7B-tuned", tuned_marker="tuned").alias("tuned"))
