"""Token-array column builders (C4, C6-C12, C16): one row per sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import bind, col


def middle_truncate(tokens, max_len: int) -> Column:
    """C4: longer than ``max_len`` → first ``int(max/2)`` + last ``int(max/2)``."""
    t = col(tokens)
    h = int(max_len / 2)
    cut = F.concat(F.slice(t, 1, h), F.slice(t, -h, h)) if h > 0 else F.slice(t, 1, 0)
    return F.when(F.size(t) > max_len, cut).otherwise(t)


def _pad(arr: Column, width: int, value, left: bool) -> Column:
    n = F.greatest(F.lit(width) - F.size(arr), F.lit(0))
    pad = F.array_repeat(F.lit(value).cast(arr_type_hint(value)), n)
    return F.concat(pad, arr) if left else F.concat(arr, pad)


def arr_type_hint(value) -> str:
    return "double" if isinstance(value, float) else "bigint"


def pad_or_truncate(arr, max_len: int, pad_value, left_pad: bool = True, truncation: str = "error") -> Column:
    """C6 for one array: shorter → padded (left or right); longer → keep the
    left part (``right``), the right part (``left``) or fail (``error``)."""
    a = col(arr)
    n = F.size(a)
    padded = _pad(a, max_len, pad_value, left_pad)
    if truncation == "right":
        longer = F.slice(a, 1, max_len)
    elif truncation == "left":
        longer = F.slice(a, -max_len, max_len)
    elif truncation == "error":
        longer = F.raise_error(F.concat(n.cast("string"), F.lit(f" tokens do not fit into {max_len}")))
    else:
        raise NotImplementedError(f"truncation is left, right or error, not {truncation!r}")
    return F.when(n < max_len, padded).when(n > max_len, longer).otherwise(a)


def position_ids(mask) -> Column:
    """``clip(cumsum(mask) - 1, 0)`` along the array (one running fold).

    Spark has no array scan, so the fold appends to its output array (cost
    grows with the square of the width): meant for prompt-width arrays.  For
    long sequences use the token-grain form
    :func:`trellis.operators.prompts.with_position_ids` (a running-sum window
    per sequence)."""
    init = F.struct(F.lit(0).cast("long").alias("run"), F.array().cast("array<bigint>").alias("out"))

    def step(s, x):
        run = s["run"] + x
        return F.struct(run.alias("run"),
                        F.concat(s["out"], F.array(F.greatest(run - 1, F.lit(0).cast("long")))).alias("out"))

    return F.aggregate(col(mask), init, step, lambda s: s["out"])


def eos_mask(ids, eos) -> Column:
    """1 up to and including the first eos token, 0 after; all 1 without eos.
    ``eos`` is one id or a list of ids."""
    eos_ids = eos if isinstance(eos, (list, tuple)) else [eos]

    def body(v):
        hits = F.filter(F.transform(v["a"], lambda x, i: F.when(x.isin(*eos_ids), i + 1)), lambda i: i.isNotNull())
        first = F.coalesce(F.array_min(hits), F.size(v["a"]))
        return F.transform(v["a"], lambda _, i: F.when(i + 1 <= first, 1).otherwise(0))

    return bind({"a": col(ids)}, body)


def pad_ragged(arr, width: Column | int, pad_value) -> Column:
    """Right pad to ``width`` (the batch maximum or a larger max); never truncates."""
    a = col(arr)
    w = width if isinstance(width, Column) else F.lit(width)
    pad = F.array_repeat(F.lit(pad_value).cast(arr_type_hint(pad_value)), F.greatest(w - F.size(a), F.lit(0)))
    return F.concat(a, pad)


def continue_positions(prompt_pos, response_width: int) -> Column:
    """Response positions continue from the last prompt position."""
    def body(v):
        last = F.element_at(v["p"], -1)
        return F.concat(v["p"], F.transform(F.sequence(F.lit(1), F.lit(response_width)), lambda d: last + d))

    return bind({"p": col(prompt_pos)}, body)


def response_part(arr, response_width: int) -> Column:
    """C11: the last ``R`` entries (the response part of a full-width array)."""
    return F.slice(col(arr), -response_width, response_width)


def prompt_part(arr, response_width: int) -> Column:
    """C11: everything before the last ``R`` entries."""
    a = col(arr)
    return F.slice(a, 1, F.size(a) - response_width)


def valid_slices(prompt_ids, response_ids, n_prompt, n_response) -> tuple[Column, Column]:
    """prompt = last ``n`` ids (left padded), response = first ``m`` ids;
    ``n = 0`` gives an empty prompt."""
    p, r = col(prompt_ids), col(response_ids)
    n = col(n_prompt)
    vp = F.when(n == 0, F.slice(p, 1, 0)).otherwise(F.slice(p, -n, n))
    vr = F.slice(r, 1, col(n_response))
    return vp, vr


def response_window(arr, response_width: int) -> Column:
    """Values for response token t sit at t-1: ``a[-R-1:-1]``."""
    a = col(arr)
    return F.slice(a, F.size(a) - response_width, response_width)


def array_sum(arr) -> Column:
    return F.aggregate(col(arr), F.lit(0).cast("long"), lambda acc, x: acc + x)
