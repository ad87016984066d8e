"""How filters interact: what each removes after every choice of filters before it.

Each filter's failing rows are one relation of ids, stored as a table of its own
(one Parquet folder per filter). What a filter removes after a prefix of others is
its relation left-anti joined with the relation of each filter in the prefix; what
the joins take away was removed earlier: that is its redundancy there. Label losses
come the same way: the ids that carry a label, left-semi joined with each filter's
relation, are stored beside it and go through the same anti joins.

What is left after a prefix does not depend on the order inside it, so ``k`` filters
need one chain of anti joins for each of their ``2^k - 1`` proper subsets, not one
for each of the ``k!`` orders. All chains start from one relation that holds every
filter's rows: rows of a filter of the prefix fall out by themselves. Every side is
dealt by id, so Spark shuffles each relation once and uses it again in all chains;
ids are unique, so no key is hot. Counts per part are summed in the tasks. The orders
are put together from those counts: a few hundred rows for a part.

Defined results: a null text is empty; a null ``doc_id`` has no order, so such a row
neither is a duplicate of a smaller id nor makes another one; rows that repeat (same
id, same text) are rows of their own, none a duplicate of the other; a label counts
if any row of the labels gives it to the id; null parts are one part, the empty
string; whole texts are read, however long; an empty table gives an empty result.
Only the columns named here are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import shared_path, shared_table, white_words

#: The filters of :func:`text_filters`, in their usual order.
FILTERS = ("A", "B", "C", "D", "E")
LABELS = ("good", "toxic")


def text_filters(rows: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with what the conditions need (each measured once), and the failure
    conditions: A too few words, B too few different words, C too many capitals, D
    symbols of markup."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("words", white_words(F.col(text))).withColumns({
        "n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words")),
        "n_capitals": F.regexp_count(whole, F.lit("[A-Z]")), "n_points": F.length(whole), "symbol": whole.rlike(r"[#$%&*|]")}).drop("words")
    return rows, {"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
                  "C": 100 * F.col("n_capitals") > 2 * F.col("n_points"), "D": F.col("symbol")}


def screened(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) to a written table (row, doc_id, part, fails):
    the filters that each row fails, E (the text of a smaller id) among them."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows, fails = text_filters(rows, "text")
    local = F.array_compact(F.array(*[F.when(condition, F.lit(f)) for f, condition in fails.items()]))
    body = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = shared_table(rows.select("row", "doc_id", "part", local.alias("local"), body.alias("body")), "audit-rows")  # the rows' numbers are told once
    first = rows.groupBy("body").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = shared_table(first.select("body", "first"), "audit-copies")  # a table, so that AQE can split a text that very many hold
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "body", "left").select(
        "row", "doc_id", "part", F.when(copy, F.concat("local", F.array(F.lit("E")))).otherwise(F.col("local")).alias("fails"))


def failing_ids(rows: DataFrame, labels: DataFrame, filters: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``rows`` (row, doc_id, part, fails) and ``labels`` (doc_id, quality, toxic) to
    (all relations as one: filter, row, part, kind), and each filter's own (row).
    ``kind``: ``all``, or the label for which the row stands there again."""
    spark = rows.sparkSession
    path = shared_path(spark, "failing-ids")
    failing = rows.select("row", "doc_id", "part", F.explode("fails").alias("filter"))
    failing.write.partitionBy("filter").option("compression", "zstd").parquet(f"{path}/all")
    failing = spark.read.schema(failing.schema).parquet(f"{path}/all")
    kinds = failing.select("filter", "row", "part", F.lit("all").alias("kind"))
    for label, has in (("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)):
        ids = labels.where(has).select(F.col("doc_id").cast("long").alias("doc_id"))
        kinds = kinds.unionByName(failing.join(ids, "doc_id", "left_semi").select("filter", "row", "part", F.lit(label).alias("kind")))
    return shared_table(kinds, "failing-kinds"), {f: failing.where(F.col("filter") == f).select("row") for f in filters}


def removals(kinds: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(prefix, filter, part, kind, n): rows of the filter that no filter of the
    prefix has, for every proper subset of the filters as prefix (sorted, joined)."""
    chains = []
    for k in range(len(tables)):
        for prefix in combinations(sorted(tables), k):
            left = kinds
            for f in prefix:
                left = left.join(tables[f], "row", "left_anti")
            chains.append(left.select(F.lit("".join(prefix)).alias("prefix"), "filter", "part", "kind"))
    together = chains[0]
    for c in chains[1:]:
        together = together.unionByName(c)
    return together.groupBy("prefix", "filter", "part", "kind").agg(F.count(F.lit(1)).alias("n"))


def report(totals: DataFrame, counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """``totals`` (part, total) and ``counts`` of :func:`removals` to a row per part,
    order and step (see :func:`audit`)."""
    sums = counts.groupBy("part", "prefix", "filter").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
          for kind, name in (("all", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    facts = totals.join(sums.groupBy("part").agg(F.collect_list(F.struct(  # (2^k - 1) k / 2 entries at most
        "prefix", "filter", "removed", "good_lost", "toxic_lost")).alias("facts")), "part", "left")
    # the orders are a fixed list, so every part gets its own copy: no join
    orders = F.split(F.lit(",".join("".join(x) for x in permutations(filters))), ",")
    before = F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")
    asked = facts.select("part", "total", F.explode(orders).alias("filter_order")).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.length("filter_order")))).withColumns({
            "filter": F.substring("filter_order", F.col("step"), F.lit(1)), "prefix": F.array_join(F.array_sort(before), "")})
    known = facts.select("part", F.explode("facts").alias("y")).select("part", "y.*")
    others = {f: "".join(sorted(set(filters) - {f})) for f in filters}
    own = known.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == "", F.col("removed"))).alias("failing"),
        F.sum(F.when(_one_of(others), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * _orders(len(filters))).alias("shapley"))
    zero = {c: 0 for c in ("removed", "good_lost", "toxic_lost", "failing", "unique_fails", "shapley")}
    joined = asked.join(known, ["part", "prefix", "filter"], "left").join(own, ["part", "filter"], "left").fillna(zero)
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return joined.select("part", "filter_order", "step", "filter", (F.col("total") - gone).alias("kept"), "removed",
                         (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def _one_of(others: dict[str, str]) -> Column:
    """Whether the prefix is all filters but the row's own."""
    found = F.lit(False)
    for f, rest in others.items():
        found = found | ((F.col("filter") == f) & (F.col("prefix") == rest))
    return found


def _orders(n: int) -> Column:
    """In how many of all orders of ``n`` filters exactly the prefix comes first."""
    ways = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    return F.element_at(ways, F.length("prefix") + 1)


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row per part (source), order of all filters and step: part, filter_order,
    step, filter, kept (rows after the step), removed (at it), redundant (failing the
    step's filter, but removed before), unique_fails (failing no other filter),
    good_lost and toxic_lost (removed rows with these labels), shapley (what the
    filter removes, summed over all orders)."""
    rows = shared_table(screened(docs), "audit-fails")
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    kinds, tables = failing_ids(rows, labels, filters)
    counts = shared_table(removals(kinds, tables), "audit-removals")
    return report(totals, counts, filters)
