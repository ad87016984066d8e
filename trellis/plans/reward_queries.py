"""Registered queries for reward scoring (E*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.functions import rewards as R
from trellis.functions import text as T
from trellis.operators import rewards as OR
from trellis.operators import spans as OS
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.sources import views as V

_RESP = f"WITH {Q.RESPONSES}"
_SPANS = Q.spans_sql("response")
_EXACT_SUM = f"list_sum(list_transform({_SPANS}, lambda s: CASE WHEN contains(context, s) THEN 1 ELSE 0 END))"
_SPAN_SCORE = (f"CASE WHEN len({_SPANS}) = 0 THEN 0.2 ELSE least(1.0, coalesce({_EXACT_SUM}, 0)::DOUBLE / len({_SPANS})) END")
_ACC = Q.set_f1_sql(Q.extract_answer_sql("response"), "ground_truth")


@register("e1_evidence_format", _RESP + f"""
SELECT doc_id, {Q.evidence_format_sql('response')} AS format_score FROM responses""")
def e1_evidence_format(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return finish(r.select("doc_id", R.evidence_format("response").alias("format_score")))


@register("e2_extract_answer", _RESP + f"""
SELECT doc_id, {Q.extract_answer_sql('response')} AS answer FROM responses""")
def e2_extract_answer(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return r.select("doc_id", R.extract_answer("response").alias("answer"))


@register("e3_set_f1", _RESP + f"""
SELECT doc_id, {Q.r6(_ACC)} AS accuracy FROM responses""")
def e3_set_f1(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return finish(r.select("doc_id", R.set_f1(R.extract_answer("response"), "ground_truth").alias("accuracy")))


@register("e4_retrieval_spans", _RESP + f"""
SELECT doc_id, len({_SPANS})::INTEGER AS n_spans, array_to_string({_SPANS}, '|') AS spans FROM responses""")
def e4_retrieval_spans(spark, sf_dir):
    r = V.responses(spark, sf_dir).withColumn("s", R.retrieval_spans("response"))
    return r.select("doc_id", F.size("s").alias("n_spans"), F.array_join("s", "|").alias("spans"))


@register("e5_exact_span_match", _RESP + f"""
SELECT doc_id, (i - 1)::INTEGER AS idx, s AS span, CASE WHEN contains(context, s) THEN 1 ELSE 0 END AS exact
FROM (SELECT doc_id, context, unnest({_SPANS}) AS s, unnest(range(1, len({_SPANS}) + 1)) AS i FROM responses)""")
def e5_exact_span_match(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    x = r.select("doc_id", "context", F.posexplode(R.retrieval_spans("response")).alias("idx", "span"))
    return x.select("doc_id", "idx", "span", F.when(F.instr("context", F.col("span")) > 0, 1).otherwise(0).alias("exact"))


@register("e5_corpus_contains", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def e5_corpus_contains(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    return OS.corpus_contains(docs, items, "doc_id", "text", "item_id", "span")


def _soft(spark, sf_dir):
    r = V.responses(spark, sf_dir).withColumn("spans", R.retrieval_spans("response"))
    r = r.withColumn("exact", R.exact_credits("spans", "context"))
    missed = OR.missed_spans("spans", "exact", with_index=True)
    r = r.withColumn("m", missed).withColumn("hit", OR.soft_verdicts(F.col("m.s"), F.col("context")))
    x = r.select("doc_id", "context", F.explode(F.arrays_zip("m", "hit")).alias("x"))
    return x.select("doc_id", F.col("x.m.i").alias("idx"), F.col("x.m.s").alias("span"), "context", F.col("x.hit").cast("int").alias("soft"))


@register("e6_soft_span_match")
def e6_soft_span_match(spark, sf_dir):
    """Per non-verbatim span: does a window reach ratio 0.85?  (Arrow kernel;
    checked against an exhaustive search in the tests.)"""
    return _soft(spark, sf_dir).select("doc_id", "idx", "soft")


_LOW = "' ' || array_to_string(list_filter(string_split_regex(lower(context), '\\s+'), lambda t: t <> ''), ' ') || ' '"


@register("e6_soft_case_hits", _RESP + f"""
SELECT doc_id, (i - 1)::INTEGER AS idx, 1 AS soft
FROM (SELECT doc_id, context, unnest({_SPANS}) AS s, unnest(range(1, len({_SPANS}) + 1)) AS i FROM responses)
WHERE NOT contains(context, s) AND contains({_LOW}, ' ' || lower(s) || ' ')""")
def e6_soft_case_hits(spark, sf_dir):
    """The part of E6 that SQL can tell: spans whose words stand in the context but
    for case and white space reach ratio 1, so all of them are soft hits."""
    low = F.concat(F.lit(" "), F.array_join(T.py_split(F.lower("context")), " "), F.lit(" "))
    sure = F.contains(low, F.concat(F.lit(" "), F.lower("span"), F.lit(" ")))
    return _soft(spark, sf_dir).where(sure).select("doc_id", "idx", "soft")


@register("e7_span_score_exact", _RESP + f"""
SELECT doc_id, {Q.r6(_SPAN_SCORE)} AS span_score FROM responses""")
def e7_span_score_exact(spark, sf_dir):
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=False)
    return finish(out.select("doc_id", "span_score"))


@register("e8_evidence_reward_exact", _RESP + f"""
SELECT doc_id, {Q.r6(Q.evidence_format_sql('response'))} AS format_score, {Q.r6(_ACC)} AS accuracy,
       {Q.r6(_SPAN_SCORE)} AS span_score,
       {Q.r6(f"0.7 * ({_ACC}) + 0.1 * ({Q.evidence_format_sql('response')}) + 0.2 * ({_SPAN_SCORE})")} AS reward
FROM responses""")
def e8_evidence_reward_exact(spark, sf_dir):
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=False)
    return finish(out.select("doc_id", "format_score", "accuracy", "span_score", "reward"))


@register("e8_evidence_reward")
def e8_evidence_reward(spark, sf_dir):
    """Full evidence reward with half credit for soft span matches."""
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=True)
    return finish(out.select("doc_id", "format_score", "accuracy", "span_score", "reward"))


_TAG = f"WITH {Q.TAGGED}"


@register("e9_boxed_format", _TAG + """
SELECT doc_id, CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed\\{.*\\}.*') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
       AS format_score FROM tagged""")
def e9_boxed_format(spark, sf_dir):
    t = V.tagged_responses(spark, sf_dir)
    return finish(t.select("doc_id", R.boxed_format("response").alias("format_score")))


def _norm_math_sql(x: str) -> str:
    s = f"regexp_replace({x}, '\\\\left|\\\\right|\\\\!|\\$', '', 'g')"
    s = f"regexp_replace({s}, '\\\\[dt]frac', '\\\\frac', 'g')"
    s = f"regexp_replace({s}, '\\s+', '', 'g')"
    return f"regexp_replace({s}, '\\.$', '')"


_BOXED = "coalesce(nullif(regexp_extract(response, '.*\\\\boxed\\{([^{}]*)\\}', 1), ''), '')"
_MATH_ACC = (f"CASE WHEN {_norm_math_sql(_BOXED)} = {_norm_math_sql('ground_truth')} "
             f"OR (TRY_CAST({_norm_math_sql(_BOXED)} AS DOUBLE) IS NOT NULL "
             f"AND abs(TRY_CAST({_norm_math_sql(_BOXED)} AS DOUBLE) - TRY_CAST({_norm_math_sql('ground_truth')} AS DOUBLE)) "
             f"<= 1e-9 * greatest(1.0, abs(TRY_CAST({_norm_math_sql('ground_truth')} AS DOUBLE)))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_MATH_FMT = ("CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed\\{.*\\}.*') "
             "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


@register("e11_math_reward", _TAG + f"""
SELECT doc_id, {_BOXED} AS answer, {_MATH_ACC} AS accuracy, {_MATH_FMT} AS format_score,
       {Q.r6(f"0.9 * ({_MATH_ACC}) + 0.1 * ({_MATH_FMT})")} AS reward FROM tagged""")
def e11_math_reward(spark, sf_dir):
    """E10 + E11: last balanced ``\\boxed{}`` content graded against the truth."""
    out = OR.score_math(V.tagged_responses(spark, sf_dir))
    return finish(out.select("doc_id", "answer", "accuracy", "format_score", "reward"))


_TAGGED_FMT = ("CASE WHEN regexp_full_match(response, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>') "
               "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_TAGGED_ANS = (f"CASE WHEN regexp_matches(response, '<answer>(.*?)</answer>') "
               f"THEN {Q.py_strip(chr(39).join(['regexp_extract(response, ', '<answer>(.*?)</answer>', ', 1)']))} "
               f"ELSE {Q.py_strip('response')} END")


@register("e12_tagged_format", _TAG + f"""
SELECT doc_id, {_TAGGED_FMT} AS format_score FROM tagged""")
def e12_tagged_format(spark, sf_dir):
    t = V.tagged_responses(spark, sf_dir)
    return finish(t.select("doc_id", R.tagged_format("response").alias("format_score")))


@register("e13_tagged_answer", _TAG + f"""
SELECT doc_id, {_TAGGED_ANS} AS answer,
       CASE WHEN {_TAGGED_ANS} = {Q.py_strip('ground_truth')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM tagged""")
def e13_tagged_answer(spark, sf_dir):
    t = V.tagged_responses(spark, sf_dir)
    return finish(t.select("doc_id", R.tagged_answer("response").alias("answer"),
                           R.tagged_accuracy("response", "ground_truth").alias("accuracy")))


@register("e14_tagged_reward", _TAG + f"""
SELECT doc_id, (0.5 * (CASE WHEN {_TAGGED_ANS} = {Q.py_strip('ground_truth')} THEN 1.0 ELSE 0.0 END)
       + 0.5 * ({_TAGGED_FMT}))::DOUBLE AS reward FROM tagged""")
def e14_tagged_reward(spark, sf_dir):
    t = V.tagged_responses(spark, sf_dir)
    return finish(t.select("doc_id", R.tagged_reward("response", "ground_truth").alias("reward")))


@register("e15_score_by_name")
def e15_score_by_name(spark, sf_dir):
    """Scorer chosen by name (here the evidence scorer, soft matching on)."""
    out = OR.score_rollouts(V.responses(spark, sf_dir), "retrieve", key="doc_id")
    return finish(out.select("doc_id", "reward"))


_EXACT = f"0.7 * ({_ACC}) + 0.1 * ({Q.evidence_format_sql('response')}) + 0.2 * ({_SPAN_SCORE})"


#: Neighbouring ids that make a batch of rollouts.
_ROLLOUTS = 64


def _placed(spark, sf_dir, soft):
    """Scores on the last token of each response; the width is that of the longest of
    its batch, so one long response widens no other batch."""
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=soft)
    out = finish(out.select("doc_id", "reward", T.word_count("response").alias("response_len")))
    batch = Window.partitionBy(F.floor(F.col("doc_id") / _ROLLOUTS))
    return OR.place_rewards(out.withColumn("width", F.max("response_len").over(batch)), "width").select(
        "doc_id", "response_len", "token_level_scores")


@register("e16_place_reward", _RESP + f""",
sc AS (SELECT doc_id, {Q.r6(_EXACT)} AS reward, len({Q.ws_split('response')})::INTEGER AS response_len FROM responses),
m AS (SELECT *, max(response_len) OVER (PARTITION BY doc_id // {_ROLLOUTS}) AS width FROM sc)
SELECT doc_id, response_len, list_transform(range(0, width),
       lambda i: CASE WHEN i = (CASE WHEN response_len = 0 THEN width - 1 ELSE response_len - 1 END)
                 THEN reward ELSE 0.0 END) AS token_level_scores
FROM m""")
def e16_place_reward(spark, sf_dir):
    """The verbatim reward, which SQL can check."""
    return _placed(spark, sf_dir, False)


@register("e16_place_reward_full")
def e16_place_reward_full(spark, sf_dir):
    """With half credit for soft span matches."""
    return _placed(spark, sf_dir, True)


def _validated(spark, sf_dir, soft):
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=soft)
    placed = OR.place_rewards(out.select("doc_id", "reward", F.lit(1).alias("response_len")), 1)
    return finish(OR.validation_score(placed))


@register("e17_validation_score", _RESP + f"""
SELECT {Q.r6(f"avg({_EXACT})")} AS val_score, count(*) AS n_rows FROM responses""")
def e17_validation_score(spark, sf_dir):
    return _validated(spark, sf_dir, False)


@register("e17_validation_score_full")
def e17_validation_score_full(spark, sf_dir):
    """The validation score with soft matching on."""
    return _validated(spark, sf_dir, True)


def _inspected(spark, sf_dir, soft):
    out = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=soft)
    return finish(OR.inspect_samples(out.select("doc_id", "response", "ground_truth", "reward"), 5, "doc_id"))


@register("e18_inspect_samples", _RESP + f"""
SELECT doc_id, response, ground_truth, {Q.r6(_EXACT)} AS reward
FROM responses ORDER BY doc_id LIMIT 5""")
def e18_inspect_samples(spark, sf_dir):
    return _inspected(spark, sf_dir, False)


@register("e18_inspect_samples_full")
def e18_inspect_samples_full(spark, sf_dir):
    return _inspected(spark, sf_dir, True)


@register("e8_reward_bounds", _RESP + f"""
SELECT doc_id, {Q.r6(_EXACT)} AS verbatim, true AS in_bounds FROM responses""")
def e8_reward_bounds(spark, sf_dir):
    """The full reward lies between the verbatim one and that plus half the
    missed spans' credit."""
    full = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=True).select("doc_id", "reward", "spans", "context")
    full = full.withColumn("missed", F.size(F.filter(R.exact_credits("spans", "context"), lambda e: e == 0)))
    exact = OR.score_evidence(V.responses(spark, sf_dir), "doc_id", soft=False).select("doc_id", F.col("reward").alias("verbatim"))
    most = F.when(F.size("spans") > 0, 0.2 * 0.5 * F.col("missed") / F.size("spans")).otherwise(F.lit(0.0))
    gain = F.col("reward") - F.col("verbatim")
    return finish(full.join(exact, "doc_id").select("doc_id", "verbatim", ((gain >= -1e-9) & (gain <= most + 1e-9)).alias("in_bounds")))


@register("e15_score_by_name_tagged", _TAG + f"""
SELECT doc_id, {_TAGGED_FMT} AS format_score,
       CASE WHEN {_TAGGED_ANS} = {Q.py_strip('ground_truth')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy,
       (0.5 * (CASE WHEN {_TAGGED_ANS} = {Q.py_strip('ground_truth')} THEN 1.0 ELSE 0.0 END)
        + 0.5 * ({_TAGGED_FMT}))::DOUBLE AS reward FROM tagged""")
def e15_score_by_name_tagged(spark, sf_dir):
    """The scorer registry resolving the two-argument tagged scorer by name."""
    out = OR.score_rollouts(V.tagged_responses(spark, sf_dir), "r1v")
    return finish(out.select("doc_id", "format_score", "accuracy", "reward"))
