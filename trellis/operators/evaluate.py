"""Long-context evaluation operators (F13-F19): dispatch, best-of, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import evaluate as E
from trellis.functions import text as T

# Dataset → metric family (the 23-entry dispatch of the evaluator).
DATASET_METRIC = {
    "narrativeqa": "qa_f1",
    "qasper": "qa_f1",
    "multifieldqa_en": "qa_f1",
    "multifieldqa_zh": "qa_f1_zh",
    "hotpotqa": "qa_f1",
    "2wikimqa": "qa_f1",
    "musique": "qa_f1",
    "2hop_qa": "qa_f1",
    "2hop_qa_v2": "qa_f1",
    "dureader": "rouge_zh",
    "gov_report": "rouge",
    "qmsum": "rouge",
    "multi_news": "rouge",
    "vcsum": "rouge_zh",
    "trec": "classification",
    "triviaqa": "qa_f1",
    "samsum": "rouge",
    "lsht": "classification",
    "passage_retrieval_en": "retrieval",
    "passage_count": "count",
    "passage_retrieval_zh": "retrieval_zh",
    "lcc": "code_sim",
    "repobench-p": "code_sim",
}

# Maximum new tokens per dataset (every listed dataset uses 4096).
DATASET_MAX_GEN = {d: 4096 for d in (
    "narrativeqa", "qasper", "multifieldqa_en", "multifieldqa_zh", "hotpotqa", "2wikimqa", "musique",
    "dureader", "gov_report", "qmsum", "multi_news", "vcsum", "trec", "triviaqa", "samsum", "lsht",
    "passage_count", "passage_retrieval_en", "passage_retrieval_zh", "lcc", "repobench-p", "2hop_qa")}

# Maximum input length per model.
MODEL_MAX_INPUT = {
    "llama2-7b-chat-4k": 3500, "longchat-v1.5-7b-32k": 31500, "xgen-7b-8k": 7500,
    "internlm-7b-8k": 7500, "chatglm2-6b": 31500, "chatglm2-6b-32k": 31500,
    "chatglm3-6b-32k": 31500, "vicuna-v1.5-7b-16k": 15500, "Qwen2.5-7B-Instruct": 32768,
    "Meta-Llama-3.1-8B-Instruct": 32768,
}

# Task category of each documented dataset.
DATASET_CATEGORY = {
    "narrativeqa": "single_doc_qa", "qasper": "single_doc_qa", "multifieldqa_en": "single_doc_qa",
    "multifieldqa_zh": "single_doc_qa", "hotpotqa": "multi_doc_qa", "2wikimqa": "multi_doc_qa",
    "musique": "multi_doc_qa", "dureader": "multi_doc_qa", "gov_report": "summarization",
    "qmsum": "summarization", "multi_news": "summarization", "vcsum": "summarization",
    "trec": "few_shot", "triviaqa": "few_shot", "samsum": "few_shot", "lsht": "few_shot",
    "passage_count": "synthetic", "passage_retrieval_en": "synthetic",
    "passage_retrieval_zh": "synthetic", "lcc": "code", "repobench-p": "code",
}

# Datasets that bypass the chat wrapper (few-shot and code sets).
NO_CHAT_DATASETS = ("trec", "triviaqa", "samsum", "lsht", "lcc", "repobench-p")

NATIVE_METRICS: dict[str, Callable[..., Column]] = {
    "qa_f1": lambda p, g, c: E.qa_f1(p, g),
    "qa_f1_zh": lambda p, g, c: E.qa_f1_zh(p, g),
    "classification": lambda p, g, c: E.classification(p, g, c),
    "retrieval": lambda p, g, c: E.passage_id_en(p, g),
    "retrieval_zh": lambda p, g, c: E.passage_id_zh(p, g),
    "count": lambda p, g, c: E.count_match(p, g),
}


def dataset_config(spark: SparkSession) -> DataFrame:
    """The per-dataset configuration table (small, fixed: 23 rows)."""
    rows = [(d, m, DATASET_MAX_GEN.get(d), d in E.FIRST_LINE_DATASETS, d not in NO_CHAT_DATASETS,
             DATASET_CATEGORY.get(d)) for d, m in DATASET_METRIC.items()]
    return spark.createDataFrame(
        rows, "dataset string, metric string, max_gen int, first_line_only boolean, chat boolean, category string")


def prepare_pred(df: DataFrame, dataset: str = "dataset", pred: str = "pred") -> DataFrame:
    """first line only for the few-shot datasets."""
    return df.withColumn(pred, E.first_line_if(dataset, pred))


TOKENIZERS = {"qa_f1": T.normalize_answer_tokens, "qa_f1_zh": E.zh_tokens}


def best_of_references(df: DataFrame, metric: str, pred: str = "pred", answers: str = "answers",
                       classes: str | None = "all_classes", out: str = "score") -> DataFrame:
    """F14 for a native metric: max over the references in one pass (no shuffle).

    Token metrics tokenise the prediction once per row (not once per reference)."""
    if metric in TOKENIZERS:
        tok = TOKENIZERS[metric]
        return df.withColumn(out, E.best_token_f1(tok(pred), answers, tok))
    fn = NATIVE_METRICS[metric]
    cls = F.col(classes) if classes and classes in df.columns else F.array().cast("array<string>")
    return df.withColumn(out, E.best_of(answers, lambda a: fn(F.col(pred), a, cls).cast("double")))


def best_of_normalized_f1(df: DataFrame, pred: str = "pred", answers: str = "answers",
                          out: str = "score") -> DataFrame:
    """F14 + F4 over text already passed through ``normalize_answer`` (tokens
    joined by one blank): tokens are recovered with a plain single-blank split."""
    def toks(c):
        return F.array_remove(F.split(c, " "), "")

    return df.withColumn(out, E.best_token_f1(toks(F.col(pred)), answers, toks))


def best_of_token_f1(df: DataFrame, pred_tokens: str, answer_tokens: str, out: str = "score") -> DataFrame:
    """F14 over pre-tokenised text: ``answer_tokens`` is an array of token
    arrays.  Lets a plan tokenise every text exactly once and join token
    arrays instead of raw text (a document that is both a prediction and a
    reference is normalised once)."""
    return df.withColumn(out, E.best_token_f1(F.col(pred_tokens), answer_tokens, lambda a: a))


def best_of_references_udf(df: DataFrame, metric: str | None, pred: str = "pred", answers: str = "answers",
                           out: str = "score") -> DataFrame:
    """F14 for a kernel metric: one Arrow call per row takes the maximum over its
    references; no shuffle.  ``metric=None`` reads each row's ``metric`` column."""
    from trellis.functions import similarity as S

    name = F.col("metric") if metric is None else F.lit(metric)
    refs = F.transform(F.col(answers), lambda a: S.prepared(name, a, False))
    return df.withColumn(out, S.best_udf(name, S.prepared(name, F.col(pred), True), refs))


def _native_best(metric: str, pred, answers: str, classes):
    """F14 as one CASE over every native metric: each row evaluates only its own
    branch, and a token metric's tokens of the prediction once."""
    out = None
    for name, fn in NATIVE_METRICS.items():
        if name in TOKENIZERS:
            branch = E.best_token_f1(TOKENIZERS[name](pred), answers, TOKENIZERS[name])
        else:
            branch = E.best_of(answers, lambda a: fn(pred, a, classes).cast("double"))
        out = F.when(F.col(metric) == name, branch) if out is None else out.when(F.col(metric) == name, branch)
    return out


def score_by_dataset(df: DataFrame, config: DataFrame) -> DataFrame:
    """metric chosen per dataset through the (broadcast, fixed) config table.

    Native metrics in one CASE expression (each row evaluates only its own), and
    one Arrow call for the kernel metrics, whose other rows carry no text to
    Python.  A dataset that the table does not have fails the job.
    """
    cfg = F.broadcast(config.select("dataset", "metric"))
    # part of the metric's value, so that no later filter can drop the row first
    unknown = F.raise_error(F.concat(F.lit("no metric for dataset "), F.coalesce(F.col("dataset"), F.lit("null"))))
    items = prepare_pred(df.join(cfg, "dataset", "left").withColumn("metric", F.coalesce("metric", unknown.cast("string"))))
    cls = F.col("all_classes") if "all_classes" in items.columns else F.array().cast("array<string>")
    is_native = F.col("metric").isin(*NATIVE_METRICS)
    native = items.filter(is_native).withColumn(
        "score", _native_best("metric", F.col("pred"), "answers", cls))
    return native.unionByName(best_of_references_udf(items.filter(~is_native), None))


def dataset_score(scored: DataFrame, dataset: str = "dataset", score: str = "score") -> DataFrame:
    """F16: per dataset ``round(100 * mean, 2)``; the unrounded mean is kept."""
    return (scored.groupBy(dataset)
            .agg(F.count(F.lit(1)).alias("n_items"), F.avg(score).alias("mean_score"))
            .withColumn("score", F.round(F.col("mean_score") * 100.0, 2)))


def length_bucket_score(scored: DataFrame, length: str = "length", dataset: str = "dataset",
                        score: str = "score") -> DataFrame:
    """per dataset and length bucket ``round(100*mean, 2)``; NaN when a
    bucket is empty (every dataset gets all three buckets)."""
    bucket = E.length_bucket(length)
    names = ("0-4k", "4-8k", "8k+")
    agg = scored.groupBy(dataset).agg(
        *[F.count(F.when(bucket == b, 1)).alias(f"n{i}") for i, b in enumerate(names)],
        *[F.avg(F.when(bucket == b, F.col(score))).alias(f"m{i}") for i, b in enumerate(names)])
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"))
                               for i, b in enumerate(names)])).alias("x")
    return agg.select(dataset, grid).select(
        dataset, "x.bucket", F.col("x.n").alias("n_items"),
        F.coalesce(F.round(F.col("x.m") * 100.0, 2), F.lit(float("nan"))).alias("score"))


def category_average(ds_scores: DataFrame, config: DataFrame) -> DataFrame:
    """macro average of dataset scores per category, plus the overall
    average (``rollup``)."""
    cfg = F.broadcast(config.filter(F.col("category").isNotNull()).select("dataset", "category"))
    j = ds_scores.join(cfg, "dataset", "inner")
    return (j.rollup("category").agg(F.count(F.lit(1)).alias("n_datasets"),
                                     F.avg("mean_score").alias("macro_mean"),
                                     F.grouping("category").alias("_total"))
            .withColumn("category", F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col("category")))
            .drop("_total"))


def category_rollup(ds_scores: DataFrame, config: DataFrame) -> DataFrame:
    """F18 with its datasets: a row per dataset, per category (macro average) and
    overall, ``rollup(category, dataset)``; ``all`` stands for what a row sums over.
    The overall row averages the datasets, as :func:`category_average` does."""
    cfg = F.broadcast(config.filter(F.col("category").isNotNull()).select("dataset", "category"))
    sums = ds_scores.join(cfg, "dataset", "inner").rollup("category", "dataset").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sum("n_items").alias("n_items"), F.avg("mean_score").alias("macro_mean"),
        *[F.grouping(c).alias(f"_{c}") for c in ("category", "dataset")])
    return sums.select(*[F.when(F.col(f"_{c}") == 1, F.lit("all")).otherwise(F.col(c)).alias(c) for c in ("category", "dataset")],
                       "n_datasets", "n_items", "macro_mean")


def generation_limits(items: DataFrame, config: DataFrame, model: str, limits: dict[str, int] | None = None) -> DataFrame:
    """max new tokens per dataset (config lookup) and max input of the model,
    from ``limits`` (model name to length; a model it lacks has no limit)."""
    cfg = F.broadcast(config.select("dataset", "max_gen"))
    return items.join(cfg, "dataset", "left").withColumn(
        "max_input", F.lit((MODEL_MAX_INPUT if limits is None else limits).get(model)).cast("int"))
