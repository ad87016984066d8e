"""Native column builders for the long-context evaluation metrics.

Every metric here is a Spark expression (no Python UDF).  Metrics that need a
dynamic programme (Rouge-L, edit ratio) live in :mod:`trellis.functions.similarity`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions import text as T


#: The place in the prediction's tokens is counted in the upper half of a long.
_STEP = 1 << 32


def falling(tokens) -> Column:
    """A token array in falling order (nulls last), as :func:`sorted_f1` takes it."""
    return F.sort_array(T.col(tokens), asc=False)


def _shared(p, g) -> Column:
    """Size of the multiset overlap of two falling token arrays: a merge, whose state
    is the place in both (one long).  A step goes on by one token, or by one of each
    where they are equal; there are as many steps as tokens, so that the tokens gone
    over beyond the steps are the overlap.  Nulls equal nothing."""
    def step(s, _):
        x = F.get(p, F.shiftright(s, 32).cast("int"))
        y = F.get(g, s.bitwiseAND(F.lit(_STEP - 1)).cast("int"))
        return s + F.when(x == y, F.lit(_STEP + 1)).when(x > y, F.lit(_STEP)).otherwise(F.lit(1).cast("long"))

    def gone(s):
        return F.shiftright(s, 32) + s.bitwiseAND(F.lit(_STEP - 1)) - F.array_size(p) - F.array_size(g)

    return F.aggregate(F.concat(p, g), F.lit(0).cast("long"), step, gone)


def multiset_overlap(p, g) -> Column:
    """``sum((Counter(p) & Counter(g)).values())``."""
    return T.bind({"p": falling(p), "g": falling(g)}, lambda v: _shared(v["p"], v["g"]))


def f1_from_counts(same, n_pred, n_truth) -> Column:
    """F1 of precision ``same/n_pred`` and recall ``same/n_truth``; 0 if no overlap."""
    same = same.cast("double")
    prec = same / n_pred.cast("double")
    rec = same / n_truth.cast("double")
    return F.when(same == 0, F.lit(0.0)).otherwise(2.0 * prec * rec / (prec + rec))


def token_f1(p, g) -> Column:
    """multiset token F1 of two token arrays."""
    return sorted_f1(falling(p), falling(g))


def sorted_f1(p, g) -> Column:
    """F3 of two arrays that :func:`falling` has sorted."""
    def score(v):
        return T.bind({"same": _shared(v["p"], v["g"])},
                      lambda o: f1_from_counts(o["same"], F.array_size(v["p"]), F.array_size(v["g"])))

    return T.bind({"p": p, "g": g}, score)


def best_token_f1(p, answers, tokens) -> Column:
    """F14 of F3: the best of the references, each made a token array by ``tokens``;
    the prediction's tokens are made and sorted once."""
    return T.bind({"p": falling(p)}, lambda v: best_of(answers, lambda a: sorted_f1(v["p"], falling(tokens(a)))))


def qa_f1(pred, truth) -> Column:
    """token F1 over normalised English answers."""
    return token_f1(T.normalize_answer_tokens(pred), T.normalize_answer_tokens(truth))


def zh_tokens(c, segmenter=None) -> Column:
    """F5 tokens: segment, normalise each token, drop empty ones.

    ``segmenter`` maps a string column to an array of tokens; the default
    splits into single characters (a dictionary segmenter is not bundled).
    """
    if segmenter is None:  # characters: what is deleted goes from the whole text at once
        return F.transform(T.char_tokens(T.delete_zh(c)), F.lower)
    return F.filter(F.transform(segmenter(c), lambda t: T.normalize_zh(t)), lambda t: t != "")


def qa_f1_zh(pred, truth, segmenter=None) -> Column:
    """token F1 over segmented, normalised Chinese answers."""
    return token_f1(zh_tokens(pred, segmenter), zh_tokens(truth, segmenter))


def classification(pred, truth, classes) -> Column:
    """F8: classes occurring in ``pred``; those that are a proper substring of
    ``truth`` are removed while iterating the same list, so the element after
    each removal is never examined.  1/len(kept) if ``truth`` is kept.
    """
    pred, truth, classes = T.col(pred), T.col(truth), T.col(classes)
    matched = F.filter(classes, lambda c: F.instr(pred, c) > 0)
    init = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(s, c):
        removable = (F.instr(truth, c) > 0) & (c != truth)
        keep = F.struct(F.lit(False).alias("skip"), F.concat(s["kept"], F.array(c)).alias("kept"))
        drop = F.struct(F.lit(True).alias("skip"), s["kept"].alias("kept"))
        return F.when(s["skip"], keep).when(removable, drop).otherwise(keep)

    kept = F.aggregate(matched, init, step, lambda s: s["kept"])
    return F.when(F.array_contains(kept, truth), 1.0 / F.size(kept)).otherwise(F.lit(0.0))


def _number_share(pred, target) -> Column:
    nums = F.regexp_extract_all(T.col(pred), F.lit(r"(?U)\d+"), 0)
    right = F.size(F.filter(nums, lambda n: n == target))
    return F.when(F.size(nums) == 0, F.lit(0.0)).otherwise(right / F.size(nums))


def count_match(pred, truth) -> Column:
    """share of the numbers in ``pred`` equal to ``truth`` (as strings)."""
    return _number_share(pred, T.col(truth))


def passage_id_en(pred, truth) -> Column:
    """id from ``Paragraph (\\d+)`` in the truth; share of numbers equal to it.
    A truth without the pattern is an error in the reference; here it yields null."""
    pid = F.regexp_extract(T.col(truth), r"(?U)Paragraph (\d+)", 1)
    return F.when(pid == "", F.lit(None).cast("double")).otherwise(_number_share(pred, pid))


def passage_id_zh(pred, truth) -> Column:
    """as F9 with ``段落(\\d+)``."""
    pid = F.regexp_extract(T.col(truth), r"(?U)段落(\d+)", 1)
    return F.when(pid == "", F.lit(None).cast("double")).otherwise(_number_share(pred, pid))


def code_first_line(pred) -> Column:
    """F12 pre-step: leading newlines off, first line without a backtick,
    ``#`` or ``//``; empty string if none."""
    lines = F.split(T.lstrip_newlines(pred), "\n")
    ok = F.filter(lines, lambda l: ~(l.contains("`") | l.contains("#") | l.contains("//")))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(""))


# Datasets whose prediction is cut to its first line.
FIRST_LINE_DATASETS = ("trec", "triviaqa", "samsum", "lsht")


def first_line_if(dataset, pred) -> Column:
    """first line only for the four few-shot datasets."""
    return F.when(T.col(dataset).isin(*FIRST_LINE_DATASETS), T.first_line(pred)).otherwise(T.col(pred))


def length_bucket(length) -> Column:
    """F17 bucket of an item length."""
    n = T.col(length)
    return F.when(n < 4000, "0-4k").when(n < 8000, "4-8k").otherwise("8k+")


def best_of(answers, metric) -> Column:
    """``max(0, metric(answer) for answer in answers)``; empty → 0."""
    scores = F.transform(T.col(answers), metric)
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(scores), F.lit(0.0)))
