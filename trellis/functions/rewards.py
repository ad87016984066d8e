"""Native column builders for rule-based reward scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions import text as T

_WS_OPT = "(?U)[\\s\\x1c-\\x1f]*"


def evidence_format(resp) -> Column:
    """Stripped response fully matches ``<think>.*</think>.*Answer:.*``
    (dot-all) and its first think block holds a ``<retrieval>…</retrieval>``."""
    s = T.py_strip(resp)
    full = s.rlike(r"(?s)\A<think>.*</think>.*Answer:.*\z")
    think = F.regexp_extract(s, r"(?s)<think>(.*?)</think>", 1)
    has_span = think.rlike(r"(?s)<retrieval>.*?</retrieval>")
    return F.when(full & has_span, F.lit(1.0)).otherwise(F.lit(0.0))


def extract_answer(resp) -> Column:
    """Text after the first ``Answer:`` (anywhere), stripped; "" if none."""
    r = T.col(resp)
    idx = F.instr(r, "Answer:")
    return F.when(idx > 0, T.py_strip(F.substr(r, idx + F.lit(7)))).otherwise(F.lit(""))


def set_f1(answer, truth) -> Column:
    """F1 of the white-space token *sets*, case-sensitive; 0 if empty."""
    def body(v):
        common = F.size(F.array_intersect(v["a"], v["g"])).cast("double")
        prec = common / F.size(v["a"])
        rec = common / F.size(v["g"])
        return F.when(F.size(v["a"]) == 0, F.lit(0.0)).when(common == 0, F.lit(0.0)) \
            .otherwise(2.0 * prec * rec / (prec + rec))

    return T.bind({"a": F.array_distinct(T.py_split(answer)), "g": F.array_distinct(T.py_split(truth))}, body)


def retrieval_spans(resp) -> Column:
    """Every ``<retrieval>(.*?)</retrieval>`` (dot-all) of the raw response,
    inner white space collapsed, stripped, blank spans dropped; order and
    duplicates kept."""
    raw = F.regexp_extract_all(T.col(resp), F.lit(r"(?s)<retrieval>(.*?)</retrieval>"), 1)
    return F.filter(F.transform(raw, lambda s: T.collapse_ws(s)), lambda s: s != "")


def exact_credits(spans, context) -> Column:
    """E5 per span: 1 if the span occurs verbatim in the raw context."""
    ctx = T.col(context)
    return F.transform(T.col(spans), lambda s: F.when(F.instr(ctx, s) > 0, 1).otherwise(0))


def span_score(spans, credit_sum) -> Column:
    """0.2 when there is no span, else ``min(1, credits / n_spans)``."""
    n = F.size(T.col(spans))
    return F.when(n == 0, F.lit(0.2)).otherwise(F.least(F.lit(1.0), T.col(credit_sum).cast("double") / n))


def evidence_reward(fmt, acc, span) -> Column:
    """``0.7 * accuracy + 0.1 * format + 0.2 * span score``."""
    return 0.7 * T.col(acc) + 0.1 * T.col(fmt) + 0.2 * T.col(span)


def boxed_format(resp) -> Column:
    """Full match ``<think>.*</think>.*\\boxed{.*}.*`` (dot-all, no strip)."""
    ok = T.col(resp).rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def tagged_format(resp) -> Column:
    """Full match ``<think>.*?</think>\\s*<answer>.*?</answer>`` (dot-all)."""
    ok = T.col(resp).rlike(r"(?s)\A<think>.*?</think>" + _WS_OPT + r"<answer>.*?</answer>\z")
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def tagged_answer(resp) -> Column:
    """E13 extraction: ``<answer>(.*?)</answer>`` where ``.`` stops at a newline
    (``(?d)``: only ``\\n`` ends a line, as in Python); stripped; the whole
    stripped response when there is no such tag pair."""
    r = T.col(resp)
    pat = r"(?d)<answer>(.*?)</answer>"
    return F.when(r.rlike(pat), T.py_strip(F.regexp_extract(r, pat, 1))).otherwise(T.py_strip(r))


def normalize_math(c) -> Column:
    """String normal form used by the answer grader: no white space, no ``$``,
    ``\\left``/``\\right``, ``\\!``, trailing period; ``\\dfrac``/``\\tfrac`` → ``\\frac``."""
    s = T.col(c)
    s = F.regexp_replace(s, r"\\left|\\right|\\!|\$", "")
    s = F.regexp_replace(s, r"\\[dt]frac", r"\\frac")
    s = F.regexp_replace(s, T.WS_RUN, "")
    s = F.regexp_replace(s, r"\.$", "")
    return s


def grade_answer(given, truth) -> Column:
    """Re-aimed grader: normalised string equality, or numeric equality when
    both sides parse as numbers.  (Symbolic equality is not built.)"""
    a, b = normalize_math(given), normalize_math(truth)
    na, nb = a.try_cast("double"), b.try_cast("double")
    return (a == b) | (na.isNotNull() & nb.isNotNull() & (F.abs(na - nb) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(nb))))


def tagged_accuracy(resp, truth) -> Column:
    """1.0 if the tagged answer grades equal to the stripped truth."""
    ok = grade_answer(tagged_answer(resp), T.py_strip(truth))
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def tagged_reward(resp, truth) -> Column:
    """``0.5 * accuracy + 0.5 * format``."""
    return 0.5 * tagged_accuracy(resp, truth) + 0.5 * tagged_format(resp)


def place_reward(score, valid_len, width) -> Column:
    """Zero array of ``width`` (a number or a column) with the score at the
    last valid response position; a length of 0 puts it at index -1, i.e. the last
    slot."""
    width = F.lit(width) if isinstance(width, int) else T.col(width)
    last = F.when(T.col(valid_len) == 0, width - 1).otherwise(T.col(valid_len) - 1)
    return F.transform(F.sequence(F.lit(0), width - 1),
                       lambda i: F.when(i == last, T.col(score).cast("double")).otherwise(F.lit(0.0)))
