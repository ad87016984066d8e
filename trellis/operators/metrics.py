"""Metric roll-ups (I1-I5, A8 console line).

Metrics live in a long table ``(step, name, value)``; reports are aggregates
over row-grain and token-grain tables joined on the batch key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.batch import seeded_order


def to_long(df: DataFrame, keys: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Wide metric columns → ``(keys..., name, value)`` via ``stack``."""
    pairs = ", ".join(f"'{name}', CAST(`{c}` AS DOUBLE)" for name, c in metrics.items())
    return df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {pairs}) AS (name, value)")


def reduce_metrics(metrics: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Mean of every metric name (B20's accumulate-then-mean)."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("value"))


def data_metrics(tokens: DataFrame, seq_keys: Sequence[str], max_response_length: int,
                 by: Sequence[str] = (), use_critic: bool = True, score: str = "score",
                 reward: str = "token_level_rewards", adv: str = "advantages", ret: str = "returns",
                 values: str = "vals", mask: str = "mask") -> DataFrame:
    """Batch statistics of sequence scores and rewards, valid advantages,
    returns and values, response lengths and the critic's explained variance.

    Token statistics are aggregates over the valid tokens (``var_samp``, which
    keeps its digits for large means); sequence statistics aggregate one row per
    sequence.  Both are partial before their shuffle and meet as one row per
    batch.  Returned in long form ``(by..., name, value)``."""
    v = F.col(mask) != 0

    def valid(c):
        return F.when(v, F.col(c))

    # The metric names of the batch report (critic/score,
    # critic/rewards, critic/advantages, critic/returns, response_length,
    # critic/values, critic/vf_explained_var).
    def spread(name, c):
        return [F.avg(c).alias(f"{name}/mean"), F.max(c).alias(f"{name}/max"), F.min(c).alias(f"{name}/min")]

    per_token = spread("critic/advantages", valid(adv)) + spread("critic/returns", valid(ret))
    if use_critic:
        unexplained = F.var_samp(F.when(v, F.col(ret) - F.col(values)))
        per_token += spread("critic/values", valid(values))
        per_token.append((1.0 - unexplained / (F.var_samp(valid(ret)) + 1e-5)).alias("critic/vf_explained_var"))
    seq = tokens.groupBy(*by, *seq_keys).agg(F.sum(score).alias("_score"), F.sum(reward).alias("_reward"),
                                             F.sum(mask).cast("double").alias("_rlen"))
    per_seq = spread("critic/score", F.col("_score")) + spread("critic/rewards", F.col("_reward")) + spread("response_length", F.col("_rlen"))
    per_seq.append(F.avg((F.col("_rlen") == max_response_length).cast("double")).alias("response_length/clip_ratio"))
    out = None
    for wide in (tokens.groupBy(*by).agg(*per_token), seq.groupBy(*by).agg(*per_seq)):
        long = to_long(wide, list(by), {c: c for c in wide.columns if c not in by})
        out = long if out is None else out.unionByName(long)
    return out


# Sections whose per-token time uses response tokens ("gen") or all tokens.
TIMED_SECTIONS = ("gen", "ref", "values", "adv", "update_critic", "update_actor")


def timing_metrics(timing: DataFrame, tokens: DataFrame, step: str = "step") -> DataFrame:
    """Seconds per section and ms per token; ``gen`` divides by response
    tokens, the other sections by all tokens.  ``timing``: (step, section,
    seconds); ``tokens``: (step, prompt_tokens, response_tokens)."""
    j = timing.join(tokens, step)
    denom = F.when(F.col("section") == "gen", F.col("response_tokens")) \
        .otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    secs = j.select(step, F.concat(F.lit("timing_s/"), "section").alias("name"), F.col("seconds").alias("value"))
    per_tok = (j.filter(F.col("section").isin(*TIMED_SECTIONS))
               .select(step, F.concat(F.lit("timing_per_token_ms/"), "section").alias("name"),
                       (F.col("seconds") * 1000.0 / denom).alias("value")))
    return secs.unionByName(per_tok)


def throughput_metrics(per_step: DataFrame, n_gpus: int, step: str = "step") -> DataFrame:
    """I4: total tokens, step time and tokens / (time × gpus).  ``per_step``:
    (step, total_tokens, step_seconds)."""
    return per_step.select(step, F.col("total_tokens").cast("double").alias("perf/total_num_tokens"),
                           F.col("step_seconds").alias("perf/time_per_step"),
                           (F.col("total_tokens") / (F.col("step_seconds") * n_gpus)).alias("perf/throughput"))


# Peak dense rate per device family, FLOP/s.
DEVICE_PEAK_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "L40": 181.05e12,
                     "L20": 119.5e12, "H20": 148e12, "910B": 354e12}

LLAMA_LIKE = ("llama", "qwen2", "qwen2_vl", "qwen2_5_vl")


def model_flops_per_token(model_type: str, hidden: int, vocab: int, layers: int, heads: int, kv_heads: int,
                          intermediate: int) -> tuple[float, float]:
    """Training FLOPs of a decoder as ``(per token, per token and position)``.

    A weight takes part in one multiply-add forward and two backward: 6 FLOPs per
    token. Weights: per layer four attention maps (queries and output over all
    heads, keys and values over the kv heads) and three of the gated MLP; the
    embedding and the output map. Attention scores and their use are two products
    over the head width per pair of positions: 12 FLOPs a head and layer in
    training. Unknown model types count zero."""
    if model_type not in LLAMA_LIKE:
        return 0.0, 0.0
    width = hidden // heads
    per_layer = 2 * hidden * width * (heads + kv_heads) + 3 * hidden * intermediate
    weights = layers * per_layer + 2 * vocab * hidden
    return 6.0 * weights, 12.0 * layers * heads * width


def device_peak(device_name: str) -> float:
    for key, val in DEVICE_PEAK_FLOPS.items():
        if key in device_name:
            return val
    return float("inf")


def flops_report(seqlens: DataFrame, batch: str, length: str, seconds: str, model: dict,
                 device_name: str, n_workers: int) -> DataFrame:
    """Achieved TFLOP/s per batch ``(6N·Σlen + 12·Σlen²·head_dim·heads·layers)
    / time`` and utilisation = achieved / (peak × workers)."""
    dense6, attn12 = model_flops_per_token(**model)
    peak = device_peak(device_name) / 1e12
    agg = seqlens.groupBy(batch).agg(F.sum(length).cast("double").alias("tokens_sum"),
                                     F.sum(F.col(length).cast("double") * F.col(length)).alias("sq_sum"),
                                     F.max(seconds).alias("delta_time"))
    achieved = (F.lit(dense6) * F.col("tokens_sum") + F.lit(attn12) * F.col("sq_sum")) / F.col("delta_time") / 1e12
    return agg.select(batch, "tokens_sum", "sq_sum", achieved.alias("tflops_achieved"),
                      (achieved / F.lit(peak * n_workers)).alias("mfu"))


def console_lines(metrics: DataFrame, step: str = "step") -> DataFrame:
    """A8 console form: ``step N: - name:value`` with three decimals, names in order."""
    item = F.format_string("%s:%.3f", F.col("name"), F.col("value"))
    return metrics.groupBy(step).agg(
        F.concat(F.lit("step "), F.col(step).cast("string"), F.lit(": - "),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", item.alias("s")))),
                                          lambda x: x["s"]), " - ")).alias("line"))


# The logging backends this library writes to.
BACKENDS = ("console", "table")


def log_metrics(metrics: DataFrame, backends: Sequence[str], table_path: str | None = None,
                step: str = "step") -> DataFrame | None:
    """Fan a long metric table ``(step, name, value)`` out to the named
    backends; an unsupported backend is rejected.  ``table`` appends to a
    parquet metrics table partitioned by step; ``console`` returns the
    one-line-per-step form.  Returns the console lines when requested."""
    unknown = [b for b in backends if b not in BACKENDS]
    if unknown:
        raise ValueError(f"{unknown} is not supported")
    if "table" in backends:
        if table_path is None:
            raise ValueError("the table backend needs a path")
        metrics.write.mode("append").partitionBy(step).parquet(table_path)
    return console_lines(metrics, step) if "console" in backends else None


def validation_samples(df: DataFrame, n: int, input_col: str = "input", output_col: str = "output",
                       score_col: str = "score", key: str = "row_id", seed: int = 42) -> DataFrame | None:
    """A fixed, seeded sample of ``n`` (input, output, score) rows as one
    wide row ``input_i, output_i, score_i``; ``n = 0`` logs nothing (None).
    The order is the md5 of seed and input (not numpy's permutation)."""
    if n == 0:
        return None
    h = seeded_order(seed, F.col(input_col))
    top = df.select(h.alias("_h"), key, input_col, output_col, score_col).orderBy("_h", key).limit(n)
    s = top.agg(F.sort_array(F.collect_list(F.struct("_h", key, input_col, output_col, score_col))).alias("s"))
    cols = []
    for i in range(n):
        cols += [F.col("s")[i][input_col].alias(f"input_{i + 1}"), F.col("s")[i][output_col].alias(f"output_{i + 1}"),
                 F.col("s")[i][score_col].alias(f"score_{i + 1}")]
    return s.select(*cols)
