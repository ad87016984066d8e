"""Registered queries for the long-context evaluation operators (F*)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trellis.functions import evaluate as E
from trellis.functions import text as T
from trellis.operators import evaluate as OE
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.sources import views as V

CJK_CLASS = "[" + "".join(ch for ch in T.CJK_PUNCTUATION) + "]"


def _zh_norm_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '{Q.PUNCT}', '', 'g'), "
            f"'{CJK_CLASS}', '', 'g'), '\\s+', '', 'g')")


@register("f1_normalize_answer", f"""
WITH {Q.QA_PAIRS}
SELECT conv_id, turn, array_to_string({Q.norm_tokens('pred')}, ' ') AS norm FROM qa_pairs""")
def f1_normalize_answer(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return qa.select("conv_id", "turn", T.normalize_answer("pred").alias("norm"))


@register("f2_normalize_zh", f"""
WITH {Q.QA_PAIRS}
SELECT conv_id, turn, {_zh_norm_sql('pred')} AS norm FROM qa_pairs""")
def f2_normalize_zh(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return qa.select("conv_id", "turn", T.normalize_zh("pred").alias("norm"))


def _qa_f1_sql(pred_toks, ans_toks):
    return f"""
WITH {Q.QA_PAIRS},
items AS (SELECT conv_id * 100000 + turn AS k, conv_id, turn, dataset, pred, answers[1] AS ans FROM qa_pairs),
{Q.f1_table('items', 'k', pred_toks, ans_toks)}
SELECT conv_id, turn, dataset, {Q.r6(Q.f1_expr())} AS score
FROM items LEFT JOIN ov ON ov.k = items.k"""


@register("f3_token_f1", _qa_f1_sql(Q.ws_split("pred"), Q.ws_split("ans")))
def f3_token_f1(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return finish(qa.select("conv_id", "turn", "dataset",
                            E.token_f1(T.py_split("pred"), T.py_split(F.col("answers")[0])).alias("score")))


@register("f4_qa_f1", _qa_f1_sql(Q.norm_tokens("pred"), Q.norm_tokens("ans")))
def f4_qa_f1(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return finish(qa.select("conv_id", "turn", "dataset",
                            E.best_of("answers", lambda a: E.qa_f1(F.col("pred"), a)).alias("score")))


def _zh_toks_sql(x):
    return f"list_filter(list_transform(string_split({x}, ''), lambda c: {_zh_norm_sql('c')}), lambda t: t <> '')"


@register("f5_qa_f1_zh", _qa_f1_sql(_zh_toks_sql("pred"), _zh_toks_sql("ans")))
def f5_qa_f1_zh(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return finish(qa.select("conv_id", "turn", "dataset",
                            E.best_of("answers", lambda a: E.qa_f1_zh(F.col("pred"), a)).alias("score")))


def _classes(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    # The class list of a dataset is its label set: one small scalar subquery.
    classes = docs.select(F.sort_array(F.collect_set("source"))).scalar()
    return docs.select("doc_id", F.concat_ws(" ", "text", "source").alias("pred"),
                       F.col("source").alias("truth"), classes.alias("all_classes"))


@register("f8_classification", """
WITH cls AS (SELECT list_sort(list_distinct(list(source))) AS classes FROM documents),
items AS (SELECT d.doc_id, d.text || ' ' || d.source AS pred, d.source AS truth, cls.classes FROM documents d, cls),
m AS (SELECT doc_id, truth, c, i FROM (
        SELECT doc_id, pred, truth, unnest(classes) AS c, unnest(range(1, len(classes) + 1)) AS i FROM items)
      WHERE contains(pred, c)),
m2 AS (SELECT *, (contains(truth, c) AND c <> truth) AS rem,
              row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM m),
m3 AS (SELECT *, sum(CASE WHEN rem THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY j
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY j) - CASE WHEN grp = 0 THEN 0 ELSE 1 END AS r
       FROM m3),
kept AS (SELECT doc_id, truth, c FROM m4 WHERE NOT (rem AND r % 2 = 1)),
sc AS (SELECT doc_id, CASE WHEN sum(CASE WHEN c = truth THEN 1 ELSE 0 END) > 0 THEN 1.0 / count(*) ELSE 0.0 END AS score
       FROM kept GROUP BY doc_id)
SELECT items.doc_id, items.truth, round(coalesce(sc.score, 0.0)::DOUBLE, 6) + 0.0 AS score
FROM items LEFT JOIN sc ON sc.doc_id = items.doc_id""")
def f8_classification(spark, sf_dir):
    items = _classes(spark, sf_dir)
    return finish(items.select("doc_id", "truth", E.classification("pred", "truth", "all_classes").alias("score")))


def _numbers_sql(truth_expr, extract):
    return f"""
WITH items AS (SELECT page_id, html AS pred, {truth_expr} AS truth FROM pages),
x AS (SELECT page_id, pred, truth, {extract} AS tid, regexp_extract_all(pred, '\\d+') AS nums FROM items)
SELECT page_id, {Q.r6("CASE WHEN len(nums) = 0 THEN 0.0 ELSE len(list_filter(nums, lambda n: n = tid))::DOUBLE / len(nums) END")} AS score
FROM x"""


@register("f9_passage_id_en", _numbers_sql("'Paragraph ' || page_id::VARCHAR", "regexp_extract(truth, 'Paragraph (\\d+)', 1)"))
def f9_passage_id_en(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    truth = F.concat(F.lit("Paragraph "), F.col("page_id").cast("string"))
    return finish(p.select("page_id", E.passage_id_en("html", truth).alias("score")))


@register("f10_passage_id_zh", _numbers_sql("'段落' || page_id::VARCHAR", "regexp_extract(truth, '段落(\\d+)', 1)"))
def f10_passage_id_zh(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    truth = F.concat(F.lit("段落"), F.col("page_id").cast("string"))
    return finish(p.select("page_id", E.passage_id_zh("html", truth).alias("score")))


@register("f11_count_match", _numbers_sql("page_id::VARCHAR", "truth"))
def f11_count_match(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return finish(p.select("page_id", E.count_match("html", F.col("page_id").cast("string")).alias("score")))


@register("f13_first_line", f"""
WITH {Q.QA_PAIRS}
SELECT conv_id, turn, split_part(regexp_replace(pred, '^\\n+', ''), chr(10), 1) AS line FROM qa_pairs""")
def f13_first_line(spark, sf_dir):
    qa = V.qa_pairs(spark, sf_dir)
    return qa.select("conv_id", "turn", T.first_line("pred").alias("line"))


_DOC_BEST = f"""
WITH {Q.DOC_PAIRS},
items AS (SELECT doc_id * 2 + i - 1 AS k, doc_id, pred, answers[i] AS ans
          FROM (SELECT doc_id, pred, answers, unnest(range(1, len(answers) + 1)) AS i FROM doc_pairs)),
{Q.f1_table('items', 'k', Q.norm_tokens('pred'), Q.norm_tokens('ans'))},
per_ans AS (SELECT items.doc_id, {Q.f1_expr()} AS s FROM items LEFT JOIN ov ON ov.k = items.k),
best AS (SELECT doc_id, greatest(0.0, max(s)) AS score FROM per_ans GROUP BY doc_id),
scored AS (SELECT d.doc_id, d.dataset, d.length, coalesce(b.score, 0.0) AS score
           FROM doc_pairs d LEFT JOIN best b ON b.doc_id = d.doc_id)"""


def _doc_scored(spark, sf_dir):
    """QA F1 of the doc_pairs view.  Each document is normalised once, before
    pairing, and the normalised string (not a token array: arrays of short
    strings are ~2.5x the bytes, measured slower) is what gets shuffled."""
    items = V.doc_pairs(spark, sf_dir, T.normalize_answer)
    return OE.best_of_normalized_f1(items).select("doc_id", "dataset", "length", "score")


@register("f14_best_of_references", _DOC_BEST + f"""
SELECT doc_id, dataset, length, {Q.r6('score')} AS score FROM scored""")
def f14_best_of_references(spark, sf_dir):
    return finish(_doc_scored(spark, sf_dir))


@register("f16_dataset_score", _DOC_BEST + f"""
SELECT dataset, count(*) AS n_items, {Q.r6('avg(score)')} AS mean_score,
       round(100.0 * avg(score), 2) AS score
FROM scored GROUP BY dataset""")
def f16_dataset_score(spark, sf_dir):
    return finish(OE.dataset_score(_doc_scored(spark, sf_dir)))


@register("f17_length_bucket", _DOC_BEST + """,
b AS (SELECT dataset, CASE WHEN length < 4000 THEN '0-4k' WHEN length < 8000 THEN '4-8k' ELSE '8k+' END AS bucket,
             score FROM scored),
grid AS (SELECT dataset, bucket FROM (SELECT DISTINCT dataset FROM scored), (VALUES ('0-4k'), ('4-8k'), ('8k+')) t(bucket)),
agg AS (SELECT dataset, bucket, count(*) AS n_items, avg(score) AS m FROM b GROUP BY dataset, bucket)
SELECT grid.dataset, grid.bucket, coalesce(agg.n_items, 0) AS n_items,
       coalesce(round(100.0 * agg.m, 2), 'NaN'::DOUBLE) + 0.0 AS score
FROM grid LEFT JOIN agg ON agg.dataset = grid.dataset AND agg.bucket = grid.bucket""")
def f17_length_bucket(spark, sf_dir):
    return finish(OE.length_bucket_score(_doc_scored(spark, sf_dir)))


def _rouge_sql(pred_toks: str, ans_toks: str) -> str:
    """Rouge-L by the usual table of common-subsequence lengths: one recursion
    step per prediction token, the running maximum along the reference."""
    return f"""
WITH RECURSIVE {Q.QA_PAIRS},
t AS (SELECT conv_id, turn, {pred_toks} AS p, {ans_toks} AS g FROM (SELECT *, answers[1] AS ans FROM qa_pairs)),
dp AS (
  SELECT conv_id, turn, 0 AS i, unnest(range(1, len(g) + 1)) AS j, unnest(g) AS tok, 0::BIGINT AS v FROM t
  UNION ALL
  SELECT d.conv_id, d.turn, d.i + 1, d.j, d.tok,
         max(CASE WHEN d.tok = t.p[d.i + 1] THEN d.prev + 1 ELSE d.v END) OVER (PARTITION BY d.conv_id, d.turn ORDER BY d.j)
  FROM (SELECT *, lag(v, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY j) AS prev FROM dp) d
  JOIN t ON t.conv_id = d.conv_id AND t.turn = d.turn WHERE d.i < len(t.p)),
lcs AS (SELECT d.conv_id, d.turn, max(d.v)::DOUBLE AS n FROM dp d JOIN t USING (conv_id, turn) WHERE d.i = len(t.p) GROUP BY ALL)
SELECT t.conv_id, t.turn,
       {Q.r6("CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) END")} AS score
FROM t LEFT JOIN lcs USING (conv_id, turn)"""


@register("f6_rouge_l", _rouge_sql(Q.ws_split("pred"), Q.ws_split("ans")))
def f6_rouge_l(spark, sf_dir):
    """Rouge-L F of each turn against the previous one (Arrow kernel)."""
    out = OE.best_of_references_udf(V.qa_pairs(spark, sf_dir), "rouge")
    return finish(out.select("conv_id", "turn", "score"))


@register("f7_rouge_l_zh")
def f7_rouge_l_zh(spark, sf_dir):
    """Per character: the same kernel as f6 on other tokens (the SQL of f6 takes
    minutes on that many tokens, so none is given)."""
    out = OE.best_of_references_udf(V.qa_pairs(spark, sf_dir), "rouge_zh")
    return finish(out.select("conv_id", "turn", "score"))


@register("f12_code_line_similarity")
def f12_code_line_similarity(spark, sf_dir):
    """First code-like line of the page against its URL (edit ratio UDF)."""
    from trellis.functions.similarity import code_sim_udf

    p = V.table(spark, sf_dir, "pages")
    return finish(p.select("page_id", code_sim_udf(F.col("html"), F.col("url")).alias("score")))


def _dataset_of(id_col):
    names = list(OE.DATASET_METRIC)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(id_col, F.lit(len(names))) + 1).cast("int")).alias("dataset")


def _dispatch_items(spark, sf_dir):
    items = V.doc_pairs(spark, sf_dir).withColumn("dataset", _dataset_of("doc_id"))
    docs = V.table(spark, sf_dir, "documents")
    classes = docs.select(F.sort_array(F.collect_set("lang"))).scalar()
    return items.withColumn("all_classes", classes).withColumnRenamed("doc_id", "item_id")


@register("f15_metric_dispatch")
def f15_metric_dispatch(spark, sf_dir):
    """Every item scored by its dataset's metric (23-way dispatch), then the
    per-dataset report."""
    scored = OE.score_by_dataset(_dispatch_items(spark, sf_dir), OE.dataset_config(spark))
    return finish(OE.dataset_score(scored))


def _native_dispatch_sql():
    """Every native metric on its datasets, each by the statement of its own query."""
    names = list(OE.DATASET_METRIC)
    metric = " ".join(f"WHEN '{d}' THEN '{m}'" for d, m in OE.DATASET_METRIC.items() if m in OE.NATIVE_METRICS)
    zh = Q.f1_table("zh", "k", _zh_toks_sql("pred"), _zh_toks_sql("ans"))
    for name in ("toks", "cnt", "ov"):  # the same statement under names of its own
        zh = re.sub(rf"\b{name}\b", f"zh_{name}", zh)
    return f"""
WITH {Q.DOC_PAIRS},
it0 AS (SELECT doc_id, {"[" + ", ".join("'" + n + "'" for n in names) + "]"}[doc_id % {len(names)} + 1] AS dataset, pred, answers FROM doc_pairs),
it1 AS (SELECT doc_id, dataset, CASE dataset {metric} END AS metric,
               CASE WHEN dataset IN ('trec', 'triviaqa', 'samsum', 'lsht')
                    THEN split_part(regexp_replace(pred, '^\\n+', ''), chr(10), 1) ELSE pred END AS pred, answers FROM it0),
items AS (SELECT doc_id * 2 + i - 1 AS k, doc_id, metric, pred, answers[i] AS ans
          FROM (SELECT *, unnest(range(1, len(answers) + 1)) AS i FROM it1 WHERE metric IS NOT NULL)),
en AS (SELECT * FROM items WHERE metric = 'qa_f1'), zh AS (SELECT * FROM items WHERE metric = 'qa_f1_zh'),
{Q.f1_table('en', 'k', Q.norm_tokens('pred'), Q.norm_tokens('ans'))},
{zh},
ids AS (SELECT k, regexp_extract_all(pred, '\\d+') AS nums,
               CASE metric WHEN 'retrieval' THEN regexp_extract(ans, 'Paragraph (\\d+)', 1)
                           WHEN 'retrieval_zh' THEN regexp_extract(ans, '段落(\\d+)', 1) ELSE ans END AS id
        FROM items WHERE metric IN ('retrieval', 'retrieval_zh', 'count')),
cls AS (SELECT list_sort(list_distinct(list(lang))) AS classes FROM documents),
m AS (SELECT * FROM (SELECT k, pred, ans, unnest(classes) AS c, unnest(range(1, len(classes) + 1)) AS i FROM items, cls WHERE metric = 'classification')
      WHERE contains(pred, c)),
m2 AS (SELECT *, (contains(ans, c) AND c <> ans) AS rem, row_number() OVER (PARTITION BY k ORDER BY i) AS j FROM m),
m3 AS (SELECT *, sum(CASE WHEN rem THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING) AS grp FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY k, grp ORDER BY j) - CASE WHEN grp = 0 THEN 0 ELSE 1 END AS r FROM m3),
per_ans AS (
  SELECT k, {Q.f1_expr()} AS s FROM ov
  UNION ALL SELECT k, {Q.f1_expr()} FROM zh_ov
  UNION ALL SELECT k, CASE WHEN len(nums) = 0 THEN 0.0 ELSE len(list_filter(nums, lambda n: n = id))::DOUBLE / len(nums) END FROM ids
  UNION ALL SELECT k, CASE WHEN sum(CASE WHEN c = ans THEN 1 ELSE 0 END) > 0 THEN 1.0 / count(*) ELSE 0.0 END
            FROM m4 WHERE NOT (rem AND r % 2 = 1) GROUP BY k),
best AS (SELECT doc_id, greatest(0.0, max(s)) AS score FROM items JOIN per_ans USING (k) GROUP BY doc_id),
scored AS (SELECT dataset, coalesce(score, 0.0) AS score FROM it1 LEFT JOIN best USING (doc_id) WHERE metric IS NOT NULL)
SELECT dataset, count(*) AS n_items, {Q.r6('avg(score)')} AS mean_score, round(100.0 * avg(score), 2) AS score FROM scored GROUP BY dataset"""


@register("f15_native_dispatch", _native_dispatch_sql())
def f15_native_dispatch(spark, sf_dir):
    """The part of the dispatch whose metrics SQL can express (six of nine)."""
    cfg = OE.dataset_config(spark)
    native = F.broadcast(cfg.where(F.col("metric").isin(*OE.NATIVE_METRICS)).select("dataset"))
    return finish(OE.dataset_score(OE.score_by_dataset(_dispatch_items(spark, sf_dir).join(native, "dataset"), cfg)))


def _qa_dataset_sql(report: str):
    names = list(OE.DATASET_METRIC)
    arr = "[" + ", ".join("'" + n + "'" for n in names) + "]"
    qa = [n for n, m in OE.DATASET_METRIC.items() if m == "qa_f1"]
    cats = " ".join(f"WHEN '{d}' THEN '{c}'" for d, c in OE.DATASET_CATEGORY.items())
    qa_list = ", ".join("'" + n + "'" for n in qa)
    return f"""
WITH {Q.DOC_PAIRS},
it0 AS (SELECT doc_id, {arr}[doc_id % {len(names)} + 1] AS dataset, pred, answers FROM doc_pairs),
it1 AS (SELECT doc_id, dataset,
               CASE WHEN dataset IN ('trec', 'triviaqa', 'samsum', 'lsht')
                    THEN split_part(regexp_replace(pred, '^\\n+', ''), chr(10), 1) ELSE pred END AS pred, answers
        FROM it0 WHERE dataset IN ({qa_list})),
items AS (SELECT doc_id * 2 + i - 1 AS k, doc_id, pred, answers[i] AS ans
          FROM (SELECT doc_id, pred, answers, unnest(range(1, len(answers) + 1)) AS i FROM it1)),
{Q.f1_table('items', 'k', Q.norm_tokens('pred'), Q.norm_tokens('ans'))},
per_ans AS (SELECT items.doc_id, {Q.f1_expr()} AS s FROM items LEFT JOIN ov ON ov.k = items.k),
best AS (SELECT doc_id, greatest(0.0, max(s)) AS score FROM per_ans GROUP BY doc_id),
scored AS (SELECT it1.doc_id, it1.dataset, coalesce(best.score, 0.0) AS score FROM it1 LEFT JOIN best USING (doc_id)),
ds AS (SELECT dataset, avg(score) AS mean_score, count(*) AS n_items FROM scored GROUP BY dataset),
cat AS (SELECT *, CASE dataset {cats} END AS category FROM ds WHERE CASE dataset {cats} END IS NOT NULL)
{report}"""


def _qa_dataset_scores(spark, sf_dir):
    """(scores of the QA-metric datasets, the dataset table)."""
    items = _dispatch_items(spark, sf_dir)
    cfg = OE.dataset_config(spark)
    qa = items.join(F.broadcast(cfg.filter(F.col("metric") == "qa_f1").select("dataset")), "dataset")
    return OE.dataset_score(OE.best_of_references(OE.prepare_pred(qa), "qa_f1")), cfg


@register("f18_category_average", _qa_dataset_sql(f"""
SELECT coalesce(category, 'all') AS category, count(*) AS n_datasets, {Q.r6('avg(mean_score)')} AS macro_mean
FROM cat GROUP BY ROLLUP (category)"""))
def f18_category_average(spark, sf_dir):
    """Category macro averages over the QA-metric datasets (with ``rollup``)."""
    return finish(OE.category_average(*_qa_dataset_scores(spark, sf_dir)))


@register("f18_category_rollup", _qa_dataset_sql(f"""
SELECT coalesce(category, 'all') AS category, coalesce(dataset, 'all') AS dataset, count(*) AS n_datasets,
       sum(n_items)::BIGINT AS n_items, {Q.r6('avg(mean_score)')} AS macro_mean
FROM cat GROUP BY ROLLUP (category, dataset)"""))
def f18_category_rollup(spark, sf_dir):
    """The same with a row per dataset: ``rollup(category, dataset)``."""
    return finish(OE.category_rollup(*_qa_dataset_scores(spark, sf_dir)))


@register("f18_category_average_all")
def f18_category_average_all(spark, sf_dir):
    """Category macro averages over all datasets, each with its own metric."""
    cfg = OE.dataset_config(spark)
    scored = OE.score_by_dataset(_dispatch_items(spark, sf_dir), cfg)
    return finish(OE.category_average(OE.dataset_score(scored), cfg))


@register("f19_generation_limits", f"""
WITH items AS (SELECT doc_id, {"[" + ", ".join("'" + n + "'" for n in OE.DATASET_METRIC) + "]"}[doc_id % 23 + 1] AS dataset FROM documents)
SELECT doc_id, dataset, CASE WHEN dataset = '2hop_qa_v2' THEN NULL ELSE 4096 END AS max_gen, 32768 AS max_input
FROM items""")
def f19_generation_limits(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    items = docs.select("doc_id", _dataset_of("doc_id"))
    return OE.generation_limits(items, OE.dataset_config(spark), "Qwen2.5-7B-Instruct") \
        .select("doc_id", "dataset", "max_gen", "max_input")
