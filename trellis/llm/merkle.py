"""Merkle manifest of a dataset, and proofs by a recursive climb.

Every row is a leaf (a digest of its columns). Per group (language) the leaves stand
in order of their ids; every eight neighbours become the digest of their digests,
level by level, until one is left, the group's subroot. The subroots, in order of
their groups, give the root the same way.

:func:`manifest` builds the levels bottom-up, an aggregate over at most eight rows
each, and stores them as node rows linked to their parents. A node row also has the
digests to its left and right among its siblings, so a proof needs one row a level.
:func:`proofs` ascends with a recursive Spark query: each step joins what climbs with
the node rows it stands at, folds the siblings in and moves to the parent. Leaves of
a run have every sibling above the run in common, so they climb as one row with a
digest each; their shared siblings are carried once, in binary. What a step shuffles
is therefore an eighth of the leaves, and a node row meets only the rows below it.

The order of the leaves comes from a range partitioning on (group, id), so that a
group with a third of all rows is many partitions. Equal rows are told apart by a
running number: which of them comes first changes no digest.

Defined results: any column may be null (``-``); a null id comes before all others
and is never tampered with; null groups are one group, before all others; repeated
rows are leaves of their own; texts are hashed whole, however long; an empty table
gives an empty manifest and no proofs. Only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import ascii_lower, shared_table
from trellis.operators.sequence import global_rank, ranked

#: Children of a node.
WIDTH = 8
#: Group key of the tree over the subroots; the others are empty or begin with ``=``.
TOP = "#"
#: The columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A column's part of the leaf: its length in bytes and itself, or ``-``."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def tampered_ids(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """``docs`` to (grp, doc_id, leaf, tampered: the digest after tampering with the
    text, null where nothing changes), digests in binary."""
    text = F.col("text").cast("string")
    own = {c: F.col(c) for c in FIELDS}

    def leaf(columns: dict[str, Column]) -> Column:
        return digest(F.concat(*[field(columns[c]) for c in FIELDS]))

    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"),
        F.when(tampered_ids(F.col("doc_id")), leaf(own | {"text": ascii_lower(text)})).alias("tampered"))


def _runs(docs: DataFrame) -> DataFrame:
    """(grp, run, kids: its leaves in order), numbered from 0 in each group."""
    rows = ranked(leaves(docs).withColumn("tie", F.monotonically_increasing_id()), ["grp"], ["doc_id", "leaf", "tie"], "place")
    return rows.groupBy("grp", F.expr(f"place div {WIDTH}").alias("run")).agg(  # at most WIDTH rows
        F.array_sort(F.collect_list(F.struct("place", "doc_id", "leaf", "tampered"))).alias("kids"))


def _joined(digests: Column) -> Column:
    """The hex text of an array of digests."""
    return F.array_join(F.transform(digests, hexed), "")


def _levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """``nodes`` (grp, level, idx, digest), one level of each group, to the node rows
    of all levels above and including it but for each group's last node, and those."""
    links, tops = [], []
    while True:
        grouped = shared_table(nodes.groupBy("grp", "level", F.expr(f"idx div {WIDTH}").alias("up")).agg(  # at most WIDTH rows
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids")), f"merkle-{name}")
        alone = (F.col("up") == 0) & (F.size("kids") == 1)
        tops.append(grouped.where(alone).select("grp", "level", F.lit(0).cast("long").alias("idx"), F.col("kids")[0]["digest"].alias("digest")))
        rest = grouped.where(~alone)
        if rest.isEmpty():
            break
        others = rest.select("grp", "level", "up", "kids.digest", F.posexplode("kids").alias("at", "kid"))
        at, size = F.col("at"), F.size("digest")
        links.append(others.select(
            "grp", "level", "kid.idx", F.col("kid.digest").alias("digest"), F.col("grp").alias("p_grp"),
            (F.col("level") + 1).alias("p_level"), F.col("up").alias("p_idx"),
            _bytes(F.slice("digest", F.lit(1), at)).alias("left"), _bytes(F.slice("digest", at + 2, F.greatest(size - at - 1, F.lit(0)))).alias("right"),
            F.lit(False).alias("subroot")))
        nodes = rest.select("grp", (F.col("level") + 1).alias("level"), F.col("up").alias("idx"), digest(_joined(F.col("kids.digest"))).alias("digest"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return links, top


def _bytes(digests: Column) -> Column:
    return F.unhex(_joined(digests))


@dataclass(frozen=True)
class Manifest:
    """A built manifest: tables in the shared folder, and the root (None if empty)."""

    #: (grp, run, kids: place, doc_id, leaf, tampered): the leaves by run.
    runs: DataFrame
    #: (grp, level, idx, digest, p_grp, p_level, p_idx, left, right, subroot): the runs
    #: (level 1) and all levels above, linked to their parents; the root has none.
    nodes: DataFrame
    root: bytes | None


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (the columns in FIELDS)."""
    runs = shared_table(_runs(docs), "merkle-runs")
    lone = (F.col("run") == 0) & (F.size("kids") == 1)  # a leaf that is its group
    first = runs.select("grp", F.lit(1).alias("level"), F.col("run").alias("idx"),
                        F.when(lone, F.col("kids")[0]["leaf"]).otherwise(digest(_joined(F.col("kids.leaf")))).alias("digest"))
    links, subroots = _levels(first, "level")
    subroots = shared_table(global_rank(subroots, ["grp"], "place"), "merkle-subroots")
    upper, top = _levels(subroots.select(F.lit(TOP).alias("grp"), F.lit(0).alias("level"), F.col("place").alias("idx"), "digest"), "top")
    # a subroot is a node of its own tree and, by its place, of the tree over them
    own = subroots.select("grp", "level", "idx", "digest", "place")
    link = None
    for rows in upper:
        link = rows if link is None else link.unionByName(rows)
    no_parent = {c: F.lit(None).cast(t) for c, t in {"p_grp": "string", "p_level": "int", "p_idx": "long", "left": "binary", "right": "binary"}.items()}
    if link is None:  # one group, or none: its subroot is the root
        ends = [own.drop("place").withColumns(no_parent).withColumn("subroot", F.lit(True))]
    else:
        above = link.where("level = 0").select(F.col("idx").alias("place"), "p_grp", "p_level", "p_idx", "left", "right")
        ends = [own.join(above, "place").drop("place").withColumn("subroot", F.lit(True)), link.where("level > 0"),
                top.withColumns(no_parent).withColumn("subroot", F.lit(False))]
    nodes = ends[0]
    for rows in [*ends[1:], *links]:
        nodes = nodes.unionByName(rows)
    root = top.select("digest").head()  # one row
    return Manifest(runs, shared_table(nodes, "merkle-nodes"), bytes(root.digest) if root else None)


@contextmanager
def _whole_recursion(spark: SparkSession) -> Iterator[None]:
    """Spark stops a recursion at a number of rows by default; its depth is bounded here."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """``start`` (run_grp, run, grp, level, idx: the node it stands at, folded: array
    of digests of that node) to (run_grp, run, folded: at the root, proof: siblings on
    the way, subroot: null where it is the root)."""
    spark = start.sparkSession
    names = [f"merkle_{x}_{uuid.uuid4().hex}" for x in ("start", "nodes")]
    start.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    try:
        with _whole_recursion(spark):
            found = spark.sql(f"""
                WITH RECURSIVE climb (run_grp, run, grp, level, idx, folded, proof, subroot) AS (
                  SELECT run_grp, run, grp, level, idx, folded, X'' AS proof, CAST(NULL AS BINARY) AS subroot FROM {names[0]}
                  UNION ALL
                  SELECT c.run_grp, c.run, n.p_grp, n.p_level, n.p_idx,
                         transform(c.folded, f -> unhex(sha2(lower(hex(concat(n.left, f, n.right))), 256))),
                         concat(c.proof, n.left, n.right), CASE WHEN n.subroot THEN n.digest ELSE c.subroot END
                  FROM climb c JOIN {names[1]} n ON c.grp = n.grp AND c.level = n.level AND c.idx = n.idx
                  WHERE n.p_grp IS NOT NULL)
                SELECT c.run_grp, c.run, c.folded, c.proof, c.subroot
                FROM climb c LEFT ANTI JOIN (SELECT grp, level, idx FROM {names[1]} WHERE p_grp IS NOT NULL) n
                ON c.grp = n.grp AND c.level = n.level AND c.idx = n.idx""")
            return shared_table(found, "merkle-climb")  # the recursion runs here
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def proofs(built: Manifest) -> DataFrame:
    """A row per leaf: doc_id, leaf, subroot, root, proof (hex text of all siblings,
    level by level), folded_root (from the tampered leaf where there is one, and the
    original siblings), verified (whether that is the root); digests as hex text."""
    lone = (F.col("run") == 0) & (F.size("kids") == 1)

    def with_own(i: Column) -> Column:
        return F.transform("kids", lambda k, j: F.when(i == j, F.coalesce(k["tampered"], k["leaf"])).otherwise(k["leaf"]))

    changed = F.transform("kids", lambda k, i: F.when(lone, F.coalesce(k["tampered"], k["leaf"])).otherwise(digest(_joined(with_own(i)))))
    start = built.runs.select(F.col("grp").alias("run_grp"), "run", "grp", F.lit(1).alias("level"), F.col("run").alias("idx"), changed.alias("folded"))
    done = climb(start, built.nodes)
    rows = built.runs.withColumnRenamed("grp", "run_grp").join(done, ["run_grp", "run"]).select(
        F.posexplode("kids").alias("at", "kid"), F.col("kids.leaf").alias("run_leaves"), "folded", "proof", "subroot")
    root = F.lit(built.root.hex() if built.root else None)
    siblings = F.array_compact(F.transform("run_leaves", lambda x, j: F.when(j != F.col("at"), x)))
    rows = rows.select(
        F.col("kid.doc_id").alias("doc_id"), hexed(F.col("kid.leaf")).alias("leaf"), F.coalesce(hexed(F.col("subroot")), root).alias("subroot"),
        root.alias("root"), F.concat(_joined(siblings), hexed(F.col("proof"))).alias("proof"), hexed(F.get("folded", F.col("at"))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
