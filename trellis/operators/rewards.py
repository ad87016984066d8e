"""Reward scoring over response tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import rewards as R
from trellis.functions import similarity as S


def missed_spans(spans: str, exact: str, with_index: bool = False) -> Column:
    """The spans without a verbatim hit; ``with_index``: structs of place and span."""
    pairs = F.transform(F.arrays_zip(F.col(spans).alias("s"), F.col(exact).alias("e")),
                        lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"), x["e"].alias("e")))
    left = F.filter(pairs, lambda x: x["e"] == 0)
    return F.transform(left, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")) if with_index else x["s"])


def soft_verdicts(spans: Column, context: Column) -> Column:
    """E6 verdict per span; a context goes to Python only where a span needs it."""
    return S.soft_hits_udf(spans, F.when(F.size(spans) > 0, context))


def soft_credits(df: DataFrame, key: str, context_key: str, context: str = "context",
                 spans: str = "spans", exact: str = "exact") -> DataFrame:
    """E6 for rows that share contexts (the n samples of one prompt):
    ``(key, n_soft)``.  Each context is prepared once for the distinct spans that
    its rows missed; the verdicts are joined back and counted."""
    miss = df.select(key, context_key, F.explode(missed_spans(spans, exact)).alias("span"))
    ctx = df.select(context_key, context).dropDuplicates([context_key]) if context_key != key \
        else df.select(key, context)
    asked = miss.groupBy(context_key).agg(F.collect_set("span").alias("asked"))
    judged = (asked.join(ctx, context_key).withColumn("hit", soft_verdicts(F.col("asked"), F.col(context)))
              .select(context_key, F.explode(F.arrays_zip("asked", "hit")).alias("x"))
              .select(context_key, F.col("x.asked").alias("span"), F.col("x.hit").alias("soft")))
    return (miss.join(judged, [context_key, "span"])
            .groupBy(key).agg(F.sum(F.col("soft").cast("int")).alias("n_soft")))


def score_evidence(df: DataFrame, key: str, response: str = "response", truth: str = "ground_truth",
                   context: str = "context", soft: bool = True, context_key: str | None = None) -> DataFrame:
    """Evidence-grounded reward per response.

    Adds ``format_score, answer, accuracy, spans, span_score, reward``.  With
    ``soft=False`` only verbatim span hits earn credit (the SQL-checkable part).
    """
    out = (df.withColumn("format_score", R.evidence_format(response))
           .withColumn("answer", R.extract_answer(response))
           .withColumn("accuracy", R.set_f1("answer", truth))
           .withColumn("spans", R.retrieval_spans(response))
           .withColumn("exact", R.exact_credits("spans", context)))
    credit = F.aggregate("exact", F.lit(0.0), lambda a, e: a + e)
    if soft and (context_key is None or context_key == key):
        # every row has its own context: judge its missed spans in place (no shuffle)
        out = out.withColumn("_hits", soft_verdicts(missed_spans("spans", "exact"), F.col(context)))
        credit = credit + 0.5 * F.size(F.filter("_hits", lambda h: h))
    elif soft:
        # contexts shared by several rows (n samples of one prompt): judge each
        # distinct (context, span) once
        counts = soft_credits(out, key, context_key, context)
        out = out.join(counts, key, "left")
        credit = credit + 0.5 * F.coalesce(F.col("n_soft"), F.lit(0))
    out = out.withColumn("span_score", R.span_score("spans", credit))
    out = out.withColumn("reward", R.evidence_reward("format_score", "accuracy", "span_score"))
    return out.drop("exact", "n_soft", "_hits")


def score_math(df: DataFrame, response: str = "response", truth: str = "ground_truth") -> DataFrame:
    """Boxed-answer reward ``0.9 * accuracy + 0.1 * format``."""
    out = (df.withColumn("format_score", R.boxed_format(response))
           .withColumn("answer", S.last_boxed_udf(F.col(response)))
           .withColumn("accuracy", F.when(R.grade_answer("answer", truth), 1.0).otherwise(0.0)))
    return out.withColumn("reward", 0.9 * F.col("accuracy") + 0.1 * F.col("format_score"))


def score_tagged(df: DataFrame, response: str = "response", truth: str = "ground_truth") -> DataFrame:
    """Tagged-answer reward ``0.5 * accuracy + 0.5 * format``."""
    out = (df.withColumn("format_score", R.tagged_format(response))
           .withColumn("answer", R.tagged_answer(response))
           .withColumn("accuracy", R.tagged_accuracy(response, truth)))
    return out.withColumn("reward", 0.5 * F.col("accuracy") + 0.5 * F.col("format_score"))


#: Scorer by name: frame, id column and options to the frame with ``reward``.
SCORERS: dict[str, Callable[..., DataFrame]] = {
    "retrieve": score_evidence,
    "math": lambda df, key, **kw: score_math(df, **kw),
    "r1v": lambda df, key, **kw: score_tagged(df, **kw),
}


def register_scorer(name: str, scorer: Callable[..., DataFrame]) -> None:
    """A user's own scorer ``(frame, key, **options) -> frame with reward``."""
    if name in SCORERS:
        raise ValueError(f"there is a scorer named {name!r}")
    SCORERS[name] = scorer


def score_rollouts(df: DataFrame, name: str, key: str = "row_id", **kw) -> DataFrame:
    """Choose a scorer by name; unknown names raise."""
    if name not in SCORERS:
        raise NotImplementedError(f"no scorer named {name!r}")
    return SCORERS[name](df, key, **kw)


def place_rewards(df: DataFrame, width: int | str, score: str = "reward", valid_len: str = "response_len",
                  out: str = "token_level_scores") -> DataFrame:
    """Token-level score array with the score on the last valid token;
    ``width`` is a number or the column that holds it."""
    return df.withColumn(out, R.place_reward(score, valid_len, width))


def validation_score(df: DataFrame, rewards: str = "token_level_scores") -> DataFrame:
    """Mean over rows of the per-row reward sum."""
    return df.agg(F.avg(F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)).alias("val_score"),
                  F.count(F.lit(1)).alias("n_rows"))


def inspect_samples(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows in id order (top-n, the limit is the feature)."""
    return df.orderBy(order).limit(n)
