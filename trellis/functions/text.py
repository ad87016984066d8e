"""String helpers that reproduce Python's ``str`` rules with Spark expressions.

Python's ``split()`` / ``strip()`` treat every Unicode white-space character
(plus the separators U+001C..U+001F) as white space, while Spark's ``trim``
only strips blanks.  All white-space handling in the library goes through the
helpers below so the rule lives in one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space class of Python's str.split()/str.strip().
WS = r"[\s\x1c-\x1f]"
WS_RUN = r"(?U)" + WS + "+"
_STRIP = r"(?U)^" + WS + "+|" + WS + "+$"
_LSTRIP_NL = r"^\n+"

# Python's string.punctuation (the 32 ASCII punctuation marks).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# CJK and typographic punctuation removed by the Chinese normaliser.
CJK_PUNCTUATION = (
    "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕"
    "〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
)

# English articles removed by the answer normaliser.
ARTICLES = ("a", "an", "the")
#: An article at word boundaries; the look at one letter spares most boundary tests.
_ARTICLE = r"(?U)(?=[at])\b(?:a|an|the)\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(col(c), _STRIP, "")


def py_split(c) -> Column:
    """``str.split()`` with no argument: runs of white space, no empty tokens.
    (The input is referenced once, so no sub-expression is evaluated twice.)"""
    return F.array_remove(F.split(col(c), WS_RUN), "")


def bind(values: dict, body) -> Column:
    """Evaluate each value once and use it several times in ``body``: a
    one-element ``aggregate`` whose initial struct holds the values (Spark does
    not share sub-expressions across higher-order functions)."""
    init = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.aggregate(F.array(F.lit(0)), init, lambda acc, _: acc, body)


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()``."""
    return py_strip(F.regexp_replace(col(c), WS_RUN, " "))


def lstrip_newlines(c) -> Column:
    return F.regexp_replace(col(c), _LSTRIP_NL, "")


def first_line(c) -> Column:
    """``s.lstrip('\\n').split('\\n')[0]``."""
    return F.split_part(lstrip_newlines(c), F.lit("\n"), F.lit(1))


def remove_ascii_punctuation(c) -> Column:
    """Delete the 32 ASCII punctuation marks (faster than a character map, measured)."""
    return F.regexp_replace(col(c), r"[!-/:-@\[-`{-~]+", "")


def normalize_answer(c) -> Column:
    """Lower case, drop ASCII punctuation, replace articles at word boundaries
    with a blank, then collapse white space (F1)."""
    s = F.lower(col(c))
    s = remove_ascii_punctuation(s)
    s = F.regexp_replace(s, _ARTICLE, " ")
    return F.array_join(py_split(s), " ")


def normalize_answer_tokens(c) -> Column:
    """Tokens of :func:`normalize_answer` (``normalize_answer(s).split()``)."""
    s = F.lower(col(c))
    s = remove_ascii_punctuation(s)
    s = F.regexp_replace(s, _ARTICLE, " ")
    return py_split(s)


def normalize_zh(c) -> Column:
    """Lower case, drop ASCII and CJK punctuation, delete all white space (F2)."""
    return delete_zh(F.lower(col(c)))


def delete_zh(c) -> Column:
    """:func:`normalize_zh` without the lower case."""
    s = remove_ascii_punctuation(c)
    s = F.translate(s, CJK_PUNCTUATION, "")
    return F.regexp_replace(s, WS_RUN, "")


def char_tokens(c) -> Column:
    """Default segmenter for Chinese metrics: one token per character."""
    return F.filter(F.split(col(c), ""), lambda t: t != "")


def word_count(c) -> Column:
    return F.size(py_split(c))
