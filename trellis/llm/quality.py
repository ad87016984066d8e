"""Quality rules as a bitmask ledger. DataFrame functions only.

Every rule is evaluated once per document: the ledger keeps the measurements and
one bit per rule that failed. A policy is a named, versioned bit mask over the
ledger, so a changed policy, or the question what one rule contributes, needs
neither the texts nor the rules again: verdicts are ``fail_bits & mask`` and
ablations a count per bit pattern (at most 2^rules groups, summed map-side).

Everything is local to a row: no shuffle, no Python.

Defined results: a null, empty or blank text has no words and fails for having too
few; repeated rows each get a row; an empty table gives an empty table; the
ledger keeps all columns of the documents in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import WHITE, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")

#: Rules in bit order: a document fails where the condition holds. Bits are never
#: reused, so that old ledgers stay readable; new rules are appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclaims", "10 * n_exclaims > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": BASE + ("symbols", "exclaims", "repeated_lines", "short_words", "long_words"),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def _split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _stripped_length(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    zero = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(x, i, step):
                return F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

        start = F.struct(zero.alias("stop"), zero.alias("n"))
        return F.aggregate(let(marked, twice), start, lambda a, p: F.struct(
            (p + WINDOW).cast("long").alias("stop"),
            (a["n"] + WINDOW - F.greatest(F.lit(0).cast("long"), a["stop"] - p)).cast("long").alias("n")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, zero).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h))))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) to (row: all columns, the measurements, fail_bits)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def measure(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated(words).alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    length = F.length(text)
    measured = docs.select(
        F.struct("*").alias("row"), let(_split_words(text), measure).alias("w"), let(lines, line_counts).alias("l"),
        _stripped_length(text, WHITE).cast("long").alias("word_chars"),
        (length - _stripped_length(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (length - _stripped_length(text, "!")).cast("long").alias("n_exclaims"))
    flat = measured.select("row", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_exclaims")
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return flat.withColumn("fail_bits", bits)


def verdicts(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn("policy", F.lit(policy)).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_only (documents that only this
    rule removes, so what leaving it out would keep), n_docs."""
    m = mask(POLICIES[policy])
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
                                for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]))
    each = patterns.select("bits", "n", names.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum("n").alias("n_docs"))


def ablations(book: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """:func:`ablation` of every policy version (``policy``, ...) in one pass: the
    ledger is summed up once, into at most ``2 ** len(RULES)`` patterns of failures,
    and every policy is a mask on those."""
    policies = POLICIES if policies is None else policies
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = [name for name, _ in RULES]
    asked = F.explode(F.array(*[
        F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("long").alias("bit"),
                 F.lit(mask(rules)).cast("long").alias("mask")) for version, rules in policies.items() for rule in rules]))
    each = patterns.select("fail_bits", "n", asked.alias("r")).select("fail_bits", "n", "r.*")
    bits = F.col("fail_bits")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(bits.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(bits.bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum("n").alias("n_docs"))
