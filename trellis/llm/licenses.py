"""License scan: phrases, and an exact set-similarity join of text blocks with
license templates. DataFrame functions only.

A block is a window of words, whatever the line breaks: windows are twice as long as
the longest template and begin that far from each other, so every stretch of words as
long as a template lies in one. A block's tokens are the set of its words. It matches
a template when it holds at least ``threshold`` of the template's tokens, and among
them those that tell the license from others with much the same words (``MARKS``).
The join orders tokens by their number of occurrences in the whole corpus, rarest
first. To reach the overlap o = ceil(threshold * |T|) a block must share one of
the template's first |T| - o + 1 tokens (prefix filter), have o tokens itself
(length filter), and have o tokens from the shared one on, on either side
(positional filter). What passes is verified by intersecting the sets.

Only the templates' words are counted, and only texts with a prefix token are cut
into blocks, of which those with one are kept; texts are read twice and never shuffled. The templates are a fixed,
small parameter; their words are the only literals in the plan.

Defined results: null, empty and word-less texts have no places, no labels and
score 0; repeated rows each get a row; a very long text is as many blocks as it has
words for; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import ascii_lower, let, shared_table

#: Phrases whose consecutive words are counted, and their labels.
PHRASES: dict[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Usual license notices. Several templates may carry the same label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
#: Words that a match must hold, by label: without them the notice is another one.
MARKS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("apache",),
    "bsd": ("redistribution", "binary"),
    "cc-by": ("creative", "commons", "attribution"),
    "cc-by-nc": ("nc",),
    "cc-by-sa": ("sa",),
    "gpl-3.0": ("gnu",),
    "mpl-2.0": ("mozilla",),
}
#: The same for templates that have one by themselves.
NAMES = ("mit",)
THRESHOLD = 0.8
#: ASCII characters outside a-z and 0-9, but for the line feed.
_GAP = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_tokens(text: str) -> list[str]:
    lower = text.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    return sorted(set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)))


def marks(label: str, tokens: list[str]) -> list[str]:
    """The tokens of a template that a match must hold."""
    return [w for w in tokens if w in MARKS.get(label, NAMES)]


def stride(templates: tuple[tuple[str, str], ...]) -> int:
    """Words of the longest template: how far blocks begin from each other."""
    return max((len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)) for _, text in templates), default=1)


def _clean(text: Column) -> Column:
    """Lower-cased words parted by spaces, line feeds kept."""
    return F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _GAP, " ")


def _words(clean: Column) -> Column:
    return F.array_remove(F.split(F.translate(clean, "\n", " "), " "), "")


def _places(words: Column, phrase: list[str]) -> Column:
    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(phrase):
            same = same & (F.get(words, i + k) == w)
        return same

    starts = F.sequence(F.lit(0), F.size(words) - len(phrase))
    return F.when(F.size(words) >= len(phrase), F.filter(starts, at)).otherwise(F.array().cast("array<int>"))


def _phrases(clean: Column) -> Column:
    """n_words and the places of every phrase; a text that doesn't contain a phrase
    is not searched word by word."""
    flat = F.concat(F.lit(" "), F.array_join(_words(clean), " "), F.lit(" "))

    def found(line: Column) -> Column:
        none = F.array().cast("array<int>")

        def each(words: Column) -> Column:
            parts = [F.when(F.contains(line, F.lit(f" {p} ")), _places(words, p.split())).otherwise(none).alias(label)
                     for p, label in PHRASES.items()]
            return F.struct(F.size(words).cast("long").alias("n_words"), *parts)

        return let(F.array_remove(F.split(line, " "), ""), each)

    return let(flat, found)


def token_ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of the templates' words by occurrences in all texts, rarest first."""
    word = F.explode(_words(_clean(F.col("text").cast("string"))))
    counts = docs.select(word.alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    n = {r.w: r["count"] for r in counts.collect()}  # at most one row per template word
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def scan(docs: DataFrame, threshold: float = THRESHOLD,
         templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, places (by phrase label),
    matches (template labels with their best containment)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = [(label, template_tokens(text)) for label, text in templates]
    rank = token_ranks(docs, sorted({w for _, ws in sets for w in ws}))
    rows, prefix = [], set()
    for t, (label, ws) in enumerate(sets):
        ws = sorted(ws, key=rank.__getitem__)
        need = math.ceil(threshold * len(ws) - 1e-9)
        prefix.update(ws[:len(ws) - need + 1])
        rows += [(t, label, ws, marks(label, ws), need, k, w) for k, w in enumerate(ws[:len(ws) - need + 1])]
    spark = docs.sparkSession
    index = spark.createDataFrame(rows, "t int, label string, tokens array<string>, marks array<string>, need int, place int, token string")

    clean = _clean(F.col("text"))
    lits = F.array(*[F.lit(w) for w in sorted(prefix)])
    step = stride(templates)

    def windows(words: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(step)), lambda i: F.slice(words, i, F.lit(2 * step)))
        return F.transform(F.filter(cut, lambda b: F.arrays_overlap(b, lits)), F.array_distinct)

    none = F.array().cast("array<array<string>>")
    blocks = let(_words(clean), lambda words: F.when(F.arrays_overlap(words, lits), windows(words)).otherwise(none))
    base = shared_table(docs.select(
        F.monotonically_increasing_id().alias("at"), "doc_id", _phrases(clean).alias("p"), blocks.alias("blocks")), "license-blocks")

    vocabulary = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    each = base.select("at", F.explode("blocks").alias("block"))
    # a block's template words, rarest first; the rest of its words can't overlap
    each = each.select("at", "block", F.array_sort(F.filter(F.transform("block", lambda w: F.struct(F.try_element_at(vocabulary, w).alias("rank"), w.alias("token"))),
                                                            lambda x: x["rank"].isNotNull())).alias("known"))
    probes = each.select("at", "known", F.size("known").alias("size"), F.posexplode("known").alias("i", "x")).select(
        "at", "known", "size", "i", F.col("x.token").alias("token"))
    hits = probes.join(F.broadcast(index), "token")  # the index is the fixed templates
    hits = hits.where((F.col("size") >= F.col("need"))
                      & (F.least(F.col("size") - F.col("i"), F.size("tokens") - F.col("place")) >= F.col("need") - F.least("i", "place")))
    shared = F.size(F.array_intersect(F.col("known.token"), F.col("tokens")))
    marked = F.size(F.array_except("marks", "known.token")) == 0
    matched = (hits.where(marked).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
               .groupBy("at", "label").agg(F.max(F.col("shared") / F.size("tokens")).alias("containment"))
               .groupBy("at").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches")))
    places = F.struct(*[F.col(f"p.`{label}`").alias(label) for label in PHRASES.values()])
    return base.select("at", "doc_id", "p.n_words", places.alias("places")).join(matched, "at", "left").drop("at")
