"""Numeric column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import col


def clip_by_value(x, lo, hi) -> Column:
    """``max(min(x, hi), lo)``."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(F.least(col(x), hi), lo)


def kl_penalty(logprob, ref_logprob, kind: str = "kl") -> Column:
    """Per-token KL estimate between the policy and the reference."""
    lp, ref = col(logprob), col(ref_logprob)
    if kind == "kl":
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind == "mse":
        return 0.5 * (lp - ref) * (lp - ref)
    if kind == "low_var_kl":
        k = ref - lp
        return clip_by_value(F.exp(k) - k - 1.0, -10.0, 10.0)
    raise NotImplementedError(f"kl penalty {kind!r}")


def logsumexp(arr) -> Column:
    """Stable log-sum-exp of a numeric array (shifted by its maximum)."""
    a = col(arr)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def entropy_from_logits(logits) -> Column:
    """``logsumexp(l) - sum(softmax(l) * l)``."""
    a = col(logits)
    lse = logsumexp(a)
    return lse - F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - lse) * x)


def token_logprob(logits, label, temperature: float = 1.0) -> Column:
    """``logit[label] - logsumexp(logits)`` after dividing by the temperature."""
    a = col(logits)
    if temperature != 1.0:
        a = F.transform(a, lambda x: x / F.lit(temperature))
    return F.element_at(a, col(label) + 1) - logsumexp(a)
