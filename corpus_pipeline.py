"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; the output is written as Parquet into the shared folder and read back as
the next stage's ``docs``. All stages but the last return the columns of
``documents``; the last adds how often the mix takes each document.

Edge cases, the same in every stage: any column may be null and further columns pass
through, whatever their names (the last stage's own columns replace those of the same
name); a null, empty or blank text goes in the first stage, for it has no language;
texts are read whole, however long; rows that repeat are judged alike, and the
near-duplicate stage keeps one of them; a null id comes after all others; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontaminate, langid, linededup, mixing, simhash
from trellis.llm.common import read_table, shared_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go for which no language can be determined; mixtures stay."""
    return langid.accepted(docs, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks of lines go from the later documents, and documents
    that lose every line."""
    return linededup.deduped_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs, width=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its share of the mix: repeats, and words taken."""
    mixed = mixing.mix(docs)
    own = ["size", "source_size", "target", "repeats"]
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (*own, "taken")],
                        *own, (F.col("size") * F.col("repeats")).alias("taken"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: The learned, aligned and hashed stages cannot be expressed in SQL; tests hold
#: them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
