"""Text-similarity kernels without a native Spark form.

Each kernel is a small per-row Python helper wrapped in an Arrow-batched
``pandas_udf``; callers hand them only the rows that need them (distinct
pairs, one metric branch).
"""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


# ---------------------------------------------------------------- E6 soft span

SOFT_THRESHOLD = 0.85


class _Windows:
    """A context prepared once for all its spans: the lower-cased words joined by
    one blank, as text and code points, with each word's begin and end."""

    def __init__(self, context: str):
        words = context.lower().split()
        self.text = " ".join(words)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.stops = np.cumsum(size + 1) - 1
        self.starts = self.stops - size

    def holds(self, span: str, threshold: float) -> bool:
        """Whether any run of as many words as the span has is similar to it.
        Two upper bounds of the ratio, from the lengths and from the characters in
        common, rule out most runs; the characters are counted one at a time."""
        wanted, n = span.lower(), len(span.split())
        if not 0 < n <= len(self.starts):
            return False
        begin, end = self.starts[:len(self.starts) - n + 1], self.stops[n - 1:]
        least = threshold * (end - begin + len(wanted)) / 2 - 1e-9  # characters that must match
        near = np.flatnonzero(np.minimum(end - begin, len(wanted)) >= least)
        if len(near):
            begin, end, least = begin[near], end[near], least[near]
            common = np.zeros(len(near), np.int64)
            seen = np.zeros(len(self.points) + 1, np.int64)
            for char, times in Counter(wanted).items():
                np.cumsum(self.points == ord(char), out=seen[1:])
                common += np.minimum(seen[end] - seen[begin], times)
            left = common >= least
            begin, end = begin[left], end[left]
        else:
            begin = end = near
        matcher = difflib.SequenceMatcher(None)
        matcher.set_seq2(wanted)
        for a, b in zip(begin.tolist(), end.tolist()):
            matcher.set_seq1(self.text[a:b])
            if matcher.ratio() >= threshold:
                return True
        return False


def soft_hits(spans: list[str], context: str, threshold: float = SOFT_THRESHOLD) -> list[bool]:
    """For each span: does a window of as many context words (lower-cased, joined
    by one blank) reach a difflib ratio of ``threshold``?"""
    windows = _Windows(context)
    return [windows.holds(s, threshold) for s in spans]


@F.pandas_udf(Ty.ArrayType(Ty.BooleanType()))
def soft_hits_udf(spans: pd.Series, context: pd.Series) -> pd.Series:
    """Per row; a row without spans needs no context (pass null there)."""
    return pd.Series([soft_hits(list(s), c or "") if s is not None and len(s) else [] for s, c in zip(spans, context)], dtype=object)


# ----------------------------------------------------------- F12 edit ratio

def _popular(b: str) -> frozenset[str]:
    """Characters too frequent in a long text to begin a match (difflib's rule)."""
    if len(b) < 200:
        return frozenset()
    least = len(b) // 100 + 1
    return frozenset(c for c, n in Counter(b).items() if n > least)


def _suffix_automaton(b: str, lo: int, hi: int, popular: frozenset[str]) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """(transitions, suffix links, lengths, first ends) of the automaton of all
    pieces of ``b[lo:hi]`` without popular characters, in linear time."""
    step: list[dict[str, int]] = [{}]
    link, length, first = [-1], [0], [lo]
    last = 0

    def state(steps: dict[str, int], to: int, size: int, end: int) -> int:
        step.append(steps)
        link.append(to)
        length.append(size)
        first.append(end)
        return len(link) - 1

    def split(p: int, q: int, c: str) -> int:
        """The part of state ``q`` that ``p`` reaches, as a state of its own."""
        new = state(dict(step[q]), link[q], length[p] + 1, first[q])
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        link[q] = new
        return new

    for j in range(lo, hi):
        c = b[j]
        if c in popular:
            last = 0
            continue
        q = step[last].get(c, -1)
        if q >= 0:  # only after a popular character: the piece is known so far
            last = q if length[q] == length[last] + 1 else split(last, q, c)
            continue
        p, last = last, state({}, 0, length[last] + 1, j)
        while p >= 0 and c not in step[p]:
            step[p][c] = last
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[last] = q if length[q] == length[p] + 1 else split(p, q, c)
    return step, link, length, first


def _longest_block(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int, popular: frozenset[str]) -> tuple[int, int, int]:
    """(begin in a, begin in b, size) of the longest common block of the ranges: the
    first one in a, then in b; popular characters only lengthen it."""
    step, link, length, first = _suffix_automaton(b, blo, bhi, popular)
    at, bt, best, v, size = alo, blo, 0, 0, 0
    for i in range(alo, ahi):
        c = a[i]
        if c in popular:
            v = size = 0
            continue
        while v and c not in step[v]:
            v = link[v]
            size = length[v]
        if c in step[v]:
            v = step[v][c]
            size += 1
            if size > best:
                at, bt, best = i - size + 1, first[v] - size + 1, size
    while at > alo and bt > blo and a[at - 1] == b[bt - 1]:
        at, bt, best = at - 1, bt - 1, best + 1
    while at + best < ahi and bt + best < bhi and a[at + best] == b[bt + best]:
        best += 1
    return at, bt, best


def matching_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: the longest common block, and
    on either side of it the same again. Each range costs linear time."""
    popular, total, ranges = _popular(b), 0, [(0, len(a), 0, len(b))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        i, j, size = _longest_block(a, alo, ahi, b, blo, bhi, popular)
        if size:
            total += size
            if alo < i and blo < j:
                ranges.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                ranges.append((i + size, ahi, j + size, bhi))
    return total


def edit_ratio(a: str, b: str) -> float:
    """Integer percent similarity / 100 (matching blocks, as difflib finds them); 0
    for an empty side."""
    if not a or not b:
        return 0.0
    return int(round(100 * (2.0 * matching_characters(a, b) / (len(a) + len(b))))) / 100


@F.pandas_udf(Ty.DoubleType())
def edit_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def code_sim_udf(pred, truth):
    from trellis.functions.evaluate import code_first_line

    return edit_ratio_udf(code_first_line(pred), truth)


# ---------------------------------------------------------- F6/F7 Rouge-L

def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists, computed
    bit-parallel (one big-integer update per token of ``b``; Hyyrö's
    formulation), so whole documents stay cheap."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def rouge_l(pred: str, truth: str) -> float:
    """Rouge-L F1 over white-space tokens: ``P = lcs/len(pred)``,
    ``R = lcs/len(truth)``; empty input or no overlap → 0."""
    p, t = pred.split(), truth.split()
    lcs = lcs_length(t, p)
    if lcs == 0:
        return 0.0
    prec, rec = lcs / len(p), lcs / len(t)
    return 2 * prec * rec / (prec + rec)


@F.pandas_udf(Ty.DoubleType())
def rouge_l_pandas(pred: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(p or "", t or "") for p, t in zip(pred, truth)], dtype="float64")


def rouge_l_udf(pred, truth):
    return rouge_l_pandas(pred, truth)


def rouge_l_zh_udf(pred, truth, segmenter=None):
    """segment (default: per character), join by blanks, Rouge-L."""
    from trellis.functions import text as T

    seg = segmenter or T.char_tokens
    return rouge_l_pandas(F.array_join(seg(pred), " "), F.array_join(seg(truth), " "))


# ------------------------------------------------------------ E10 boxed

def last_boxed(text: str) -> str:
    """Content of the last ``\\boxed{...}`` with balanced braces; "" if none."""
    start = text.rfind("\\boxed{")
    if start < 0:
        return ""
    i = start + len("\\boxed{")
    depth = 1
    out = []
    while i < len(text):
        ch = text[i]
        if ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                return "".join(out)
        out.append(ch)
        i += 1
    return ""


@F.pandas_udf(Ty.StringType())
def last_boxed_udf(text: pd.Series) -> pd.Series:
    return pd.Series([last_boxed(t or "") for t in text], dtype=object)


# ------------------------------------------------------- best of references

#: Kernels of the metrics that SQL functions cannot express. Their texts are
#: prepared in the plan (segmenting, first code line); only the kernel is Python.
KERNELS = {"rouge": rouge_l, "rouge_zh": rouge_l, "code_sim": edit_ratio}


@F.pandas_udf(Ty.DoubleType())
def best_udf(metric: pd.Series, pred: pd.Series, answers: pd.Series) -> pd.Series:
    """F14 in one call per row: the largest score over the references, 0 without."""
    return pd.Series([max((KERNELS[m](p or "", a or "") for a in answers_), default=0.0) if answers_ is not None else 0.0
                      for m, p, answers_ in zip(metric, pred, answers)], dtype="float64")


def prepared(metric, text, is_pred: bool):
    """The text as the metric's kernel takes it."""
    from trellis.functions import text as T
    from trellis.functions.evaluate import code_first_line

    out = F.when(metric == "rouge_zh", F.array_join(T.char_tokens(text), " "))
    if is_pred:
        out = out.when(metric == "code_sim", code_first_line(text))
    return out.otherwise(text)
