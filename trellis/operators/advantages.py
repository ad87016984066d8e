"""Rollout statistics: masked moments, KL, advantages and loss reports (G*).

Token tables carry one row per response token with explicit sequence keys and
a position.  Per-sequence windows are bounded by the maximum response length;
group statistics (GRPO/RLOO) are aggregates joined back (the join splits hot
groups under AQE) rather than windows over a group; batch statistics are
scalar subqueries or a join with one row per batch, never a
single-partition window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import math as M

WHITEN_EPS = 1e-8


def _seq_window(seq_keys: Sequence[str], pos: str):
    return Window.partitionBy(*seq_keys).orderBy(pos)


def masked_mean_by(df: DataFrame, x: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """G1: ``sum(x*m)/sum(m)`` per ``by`` group (global when empty)."""
    m = F.col(mask).cast("double")
    return df.groupBy(*by).agg((F.sum(F.col(x) * m) / F.nullif(F.sum(m), F.lit(0.0))).alias("masked_mean"),
                               F.sum(m).alias("mask_sum"))


def masked_moments(df: DataFrame, x: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Masked mean and unbiased masked variance; raises when fewer than two
    positions are valid (the reference's two error cases)."""
    v = F.when(F.col(mask) != 0, F.col(x))
    n = F.sum((F.col(mask) != 0).cast("long"))
    var = F.var_samp(v)
    return df.groupBy(*by).agg(
        n.alias("n_valid"),
        (F.sum(F.col(x) * F.col(mask)) / F.nullif(F.sum(F.col(mask).cast("double")), F.lit(0.0))).alias("mean"),
        F.when(n == 0, F.raise_error(F.lit("the mask selects no position")))
         .when(n == 1, F.raise_error(F.lit("the mask selects one position only: there is no variance")))
         .otherwise(var).alias("var"))


def _attach_batch_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        # one row per batch: bounded by the number of batches (steps)
        return df.join(stats, list(by), "left")  # one row per batch: Spark broadcasts it by its size
    row = stats.select("mean", "var")
    return df.withColumn("mean", row.select("mean").scalar()).withColumn("var", row.select("var").scalar())


def masked_whiten(df: DataFrame, x: str, mask: str, out: str, by: Sequence[str] = (),
                  shift_mean: bool = True) -> DataFrame:
    """``(x - mean) * rsqrt(var + 1e-8)`` on every position, moments over
    the valid positions of the batch."""
    stats = masked_moments(df, x, mask, by)
    j = _attach_batch_stats(df, stats, by)
    w = (F.col(x) - F.col("mean")) / F.sqrt(F.col("var") + WHITEN_EPS)
    if not shift_mean:
        w = w + F.col("mean")
    return j.withColumn(out, w).drop("mean", "var", "n_valid")


def discounted_suffix_sum(df: DataFrame, seq_keys: Sequence[str], pos: str, x: Column, c: float, out: str) -> DataFrame:
    """``out_t = sum_{k>=t} c^(k-t) x_k`` within each sequence, 0 <= c <= 1, for
    sequences of any length and all in windows.

    Positions are cut into blocks of so many that ``c^block`` is about e^-300.
    Inside a block the sum is ``sum c^j x_j / c^j'`` over offsets j from the block's
    start, which neither under- nor overflows.  From the next block comes its whole
    sum, discounted by the distance to it; what lies beyond has a weight below
    e^-300 and no part in a double."""
    if not 0.0 <= c <= 1.0:
        raise ValueError(f"the discount must be between 0 and 1: {c}")
    w = _seq_window(seq_keys, pos).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    if c == 1.0:
        return df.withColumn(out, F.sum(x).over(w))
    if c == 0.0:
        return df.withColumn(out, x)
    size = max(1, int(-300.0 / math.log(c)))
    offset = F.col(pos) % size
    scaled = x * F.pow(F.lit(c), offset.cast("double"))
    blocked = df.withColumn("_block", F.floor(F.col(pos) / size)).withColumn("_scaled", scaled)
    inside = Window.partitionBy(*seq_keys, "_block").orderBy(pos).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = Window.partitionBy(*seq_keys).orderBy("_block").rangeBetween(1, 1)
    own = F.sum("_scaled").over(inside) / F.pow(F.lit(c), offset.cast("double"))
    after = F.coalesce(F.sum("_scaled").over(following), F.lit(0.0)) * F.pow(F.lit(c), (size - offset).cast("double"))
    return blocked.withColumn(out, own + after).drop("_block", "_scaled")


def gae(df: DataFrame, seq_keys: Sequence[str], pos: str = "pos", reward: str = "reward",
        values: str = "vals", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0,
        by: Sequence[str] = ()) -> DataFrame:
    """``delta = r + gamma*V' - V`` (V' = 0 after the last position),
    ``A = delta + gamma*lam*A'``; returns = A + V; advantages whitened over the
    batch with the mask (not masked afterwards)."""
    w = _seq_window(seq_keys, pos)
    delta = F.col(reward) + gamma * F.coalesce(F.lead(values, 1).over(w), F.lit(0.0)) - F.col(values)
    out = df.withColumn("_delta", delta)
    out = discounted_suffix_sum(out, seq_keys, pos, F.col("_delta"), gamma * lam, "_adv_raw")
    out = out.withColumn("returns", F.col("_adv_raw") + F.col(values))
    out = masked_whiten(out, "_adv_raw", mask, "advantages", by)
    return out.drop("_delta", "_adv_raw")


def _group_stats(df: DataFrame, uid: str, score: str) -> DataFrame:
    return df.groupBy(uid).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_m"),
                               F.stddev_samp(score).alias("_sd"))


def grpo(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = 1e-6,
         out: str = "advantages") -> DataFrame:
    """``(s - mean) / (std + eps)`` per uid group (sample std); a singleton
    group uses mean 0 and std 1."""
    j = df.join(_group_stats(df, uid, score), uid)
    mean = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_m"))
    std = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_sd"))
    return j.withColumn(out, (F.col(score) - mean) / (std + eps)).drop("_n", "_m", "_sd")


def rloo(df: DataFrame, uid: str = "uid", score: str = "score", out: str = "advantages") -> DataFrame:
    """``(s - mean) * n/(n-1)`` per uid group; a singleton keeps its score."""
    j = df.join(_group_stats(df, uid, score), uid)
    n = F.col("_n").cast("double")
    adv = F.when(F.col("_n") > 1, F.col(score) * n / (n - 1) - F.col("_m") * n / (n - 1)).otherwise(F.col(score))
    return j.withColumn(out, adv).drop("_n", "_m", "_sd")


def reinforce_pp(df: DataFrame, seq_keys: Sequence[str], pos: str = "pos", reward: str = "reward",
                 mask: str = "mask", gamma: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Reverse discounted return whose carry is reset after a masked
    position; advantages = whitened returns × mask; returns unmasked."""
    w = _seq_window(seq_keys, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = F.sum(1 - F.col(mask)).over(w)
    out = df.withColumn("_seg", seg)
    out = discounted_suffix_sum(out, [*seq_keys, "_seg"], pos, F.col(reward), gamma, "returns")
    out = masked_whiten(out, "returns", mask, "advantages", by)
    return out.withColumn("advantages", F.col("advantages") * F.col(mask)).drop("_seg")


def remax(df: DataFrame, seq_keys: Sequence[str], pos: str = "pos", reward: str = "reward",
          mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """returns = suffix sum of ``r * mask``; advantages = returns − baseline × mask."""
    out = discounted_suffix_sum(df, seq_keys, pos, F.col(reward) * F.col(mask), 1.0, "returns")
    return out.withColumn("advantages", F.col("returns") - F.col(baseline) * F.col(mask))


def greedy_baseline(df: DataFrame, baselines: DataFrame, keys: Sequence[str],
                    score: str = "baseline") -> DataFrame:
    """Attach the greedy pass's score per response as its baseline."""
    return df.join(baselines.select(*keys, score), list(keys), "left")


ESTIMATORS = ("gae", "grpo", "reinforce_plus_plus", "remax", "rloo")


def compute_advantage(df: DataFrame, kind: str, **kw) -> DataFrame:
    """Dispatch over the five estimators; unknown kinds raise."""
    if kind == "gae":
        return gae(df, **kw)
    if kind == "grpo":
        return grpo(df, **kw)
    if kind == "rloo":
        return rloo(df, **kw)
    if kind == "reinforce_plus_plus":
        return reinforce_pp(df, **kw)
    if kind == "remax":
        return remax(df, **kw)
    raise NotImplementedError(f"advantage estimator {kind!r}")


def apply_kl_penalty(df: DataFrame, seq_keys: Sequence[str], beta: float, kind: str = "kl",
                     score: str = "score", logprob: str = "old_lp", ref: str | None = "ref_lp",
                     mask: str = "mask") -> DataFrame:
    """``rewards = score - beta * kl * mask``; without a reference policy
    beta is 0 and kl is 0."""
    if ref is None:
        return df.withColumn("kld", F.lit(0.0)).withColumn("token_level_rewards", F.col(score))
    kld = M.kl_penalty(logprob, ref, kind) * F.col(mask)
    return df.withColumn("kld", kld).withColumn("token_level_rewards", F.col(score) - beta * F.col("kld"))


def kl_report(penalised: DataFrame, seq_keys: Sequence[str], beta: float, mask: str = "mask") -> DataFrame:
    """G6 report: current KL = mean over sequences of the per-sequence masked
    mean of the penalised KL; ``kl_coeff`` is beta before the controller update."""
    per_seq = masked_mean_by(penalised, "kld", mask, seq_keys)
    return per_seq.agg(F.avg("masked_mean").alias("current_kl"), F.lit(beta).alias("kl_coeff"))


def compute_rewards(df: DataFrame, kl_ratio: float, score: str = "score", old: str = "old_lp",
                    ref: str = "ref_lp") -> DataFrame:
    """``score - (old - ref) * ratio``."""
    return df.withColumn("rewards", F.col(score) - (F.col(old) - F.col(ref)) * kl_ratio)


def adaptive_kl(steps: DataFrame, init: float, target: float, horizon: float, run: str = "run",
                step: str = "step", kl: str = "kl", n: str = "n") -> DataFrame:
    """``value *= 1 + clip(kl/target - 1, ±0.2) * n / horizon`` applied in
    step order per run; the running product is ``exp(sum(log|mult|))`` with the
    sign from the count of negative factors and 0 once a factor is 0.
    ``kl_coef`` is the value in force at the step (before its update)."""
    mult = 1.0 + M.clip_by_value(F.col(kl) / target - 1.0, -0.2, 0.2) * F.col(n) / horizon
    w = Window.partitionBy(run).orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def running(frame):
        logs = F.sum(F.when(F.col("_mult") != 0, F.log(F.abs("_mult")))).over(frame)
        negs = F.sum((F.col("_mult") < 0).cast("int")).over(frame)
        zeros = F.sum((F.col("_mult") == 0).cast("int")).over(frame)
        mag = F.exp(F.coalesce(logs, F.lit(0.0)))
        sign = F.when(F.coalesce(negs, F.lit(0)) % 2 == 1, -1.0).otherwise(1.0)
        return F.when(F.coalesce(zeros, F.lit(0)) > 0, F.lit(0.0)).otherwise(sign * mag * init)

    out = steps.withColumn("_mult", mult)
    return (out.withColumn("kl_coef", running(before)).withColumn("kl_coef_next", running(upto))
            .drop("_mult"))


def fixed_kl(steps: DataFrame, value: float) -> DataFrame:
    """Constant coefficient."""
    return steps.withColumn("kl_coef", F.lit(value)).withColumn("kl_coef_next", F.lit(value))


def policy_loss_report(df: DataFrame, by: Sequence[str], clip: float, old: str = "old_lp",
                       lp: str = "lp", adv: str = "advantages", mask: str = "mask") -> DataFrame:
    """PPO clipped loss, clip fraction and approximate KL as masked means."""
    m = F.col(mask).cast("double")
    ratio = F.exp(F.col(lp) - F.col(old))
    l1 = -F.col(adv) * ratio
    l2 = -F.col(adv) * M.clip_by_value(ratio, 1.0 - clip, 1.0 + clip)
    msum = F.nullif(F.sum(m), F.lit(0.0))
    return df.groupBy(*by).agg(
        (F.sum(F.greatest(l1, l2) * m) / msum).alias("pg_loss"),
        (F.sum((l2 > l1).cast("double") * m) / msum).alias("pg_clipfrac"),
        (F.sum((F.col(old) - F.col(lp)) * m) / msum).alias("ppo_kl"))


def value_loss_report(df: DataFrame, by: Sequence[str], clip: float, vpred: str = "vpred",
                      returns: str = "returns", values: str = "vals", mask: str = "mask") -> DataFrame:
    """½ masked mean of the larger squared error, clip fraction, vpred mean."""
    m = F.col(mask).cast("double")
    clipped = M.clip_by_value(vpred, F.col(values) - clip, F.col(values) + clip)
    l1 = (F.col(vpred) - F.col(returns)) * (F.col(vpred) - F.col(returns))
    l2 = (clipped - F.col(returns)) * (clipped - F.col(returns))
    msum = F.nullif(F.sum(m), F.lit(0.0))
    return df.groupBy(*by).agg(
        (0.5 * F.sum(F.greatest(l1, l2) * m) / msum).alias("vf_loss"),
        (F.sum((l2 > l1).cast("double") * m) / msum).alias("vf_clipfrac"),
        (F.sum(F.col(vpred) * m) / msum).alias("vpred_mean"))


def critic_value_mask(df: DataFrame, seq_keys: Sequence[str], pos: str = "pos", values: str = "vals",
                      mask: str = "mask") -> DataFrame:
    """The critic's response mask is the attention mask shifted right by
    one (``[-R-1:-1]``): position t uses the mask of t-1 (the last prompt
    token's mask, 1, at t = 0)."""
    w = _seq_window(seq_keys, pos)
    shifted = F.coalesce(F.lag(mask, 1).over(w), F.lit(1))
    return df.withColumn("critic_mask", shifted).withColumn("masked_values", F.col(values) * shifted)


def actor_objective_report(df: DataFrame, by: Sequence[str], clip: float, entropy_coeff: float,
                           kl_coef: float | None, entropy: str = "entropy", old: str = "old_lp",
                           lp: str = "lp", ref: str = "ref_lp", adv: str = "advantages",
                           mask: str = "mask", kl_kind: str = "low_var_kl") -> DataFrame:
    """Per micro-batch ``pg_loss - entropy_loss*c1 (+ kl_loss*c2)``."""
    m = F.col(mask).cast("double")
    msum = F.nullif(F.sum(m), F.lit(0.0))
    ratio = F.exp(F.col(lp) - F.col(old))
    l1 = -F.col(adv) * ratio
    l2 = -F.col(adv) * M.clip_by_value(ratio, 1.0 - clip, 1.0 + clip)
    aggs = [(F.sum(F.greatest(l1, l2) * m) / msum).alias("pg_loss"),
            (F.sum(F.col(entropy) * m) / msum).alias("entropy_loss")]
    if kl_coef is not None:
        aggs.append((F.sum(M.kl_penalty(lp, ref, kl_kind) * m) / msum).alias("kl_loss"))
    rep = df.groupBy(*by).agg(*aggs)
    obj = F.col("pg_loss") - F.col("entropy_loss") * entropy_coeff
    if kl_coef is not None:
        obj = obj + F.col("kl_loss") * kl_coef
    return rep.withColumn("policy_loss", obj)
