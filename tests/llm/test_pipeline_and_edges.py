"""The pipeline's stages, and every operator on a hostile table."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from trellis.llm import (classifier, decontaminate, filteraudit, katz, langid, licenses, linededup, merkle, mixing, quality, simhash,
                         sitetree, tokencount)
from trellis.llm.common import shared_path

SF = "/root/testdata/sf0.01"
CONTRACTS = {
    "op1_site_tree": ["page_id", "url", "text", "n_chars"],
    "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op3_language_mixture": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_katz_backoff": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_quality_ledger": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_line_dedup": ["doc_id", "n_lines", "n_deleted", "text"],
    "op11_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
}


def test_registered_queries_return_the_contract_columns():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(names) == sorted(CONTRACTS) and "pipeline" in entry.queries()


HOSTILE = ("doc_id long, text string, lang string, source string, n_chars long, row string, id int, body int, h int, at int, size int, fp int, "
           "score int, kept int, bucket int, chunk int, docs int, target int, label string, `a.b` int, value int, url string, html string, page_id long")


@pytest.fixture(scope="module")
def hostile(spark):
    long = "long text of words " * 20_000
    texts = [(1, "the cat sat on the mat\nand all was well with it", "en", "a"), (1, "the cat sat on the mat\nand all was well with it", "en", "a"),
             (2, "the cat sat on the mat\nand all was well with it", "en", "a"), (None, "no id here at all", "en", "b"), (3, None, None, None),
             (4, "", "en", None), (5, " \n\t", "de", "b"), (6, long, "en", "c"), (7, "x" * 300_000, None, "c"), (None, None, None, None), (8, "der die das", "de", "é")]
    rows = [(i, t, lang, s, len(t or ""), "r", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, "l", 0, 0, "http://h.org/" if i else None, t, i) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, HOSTILE)


OPERATORS = {
    "sitetree": lambda d: sitetree.main_texts(d),
    "tokencount": lambda d: tokencount.token_counts(d),
    "langid": lambda d: langid.identified(d, d),
    "katz": lambda d: katz.score(d),
    "quality": lambda d: quality.verdicts(quality.ledger(d)),
    "mixing": lambda d: mixing.mix(d),
    "licenses": lambda d: licenses.scan(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "decontaminate": lambda d: decontaminate.contamination(d, d.selectExpr("doc_id AS item_id", "text").where("doc_id = 8")),
    "linededup": lambda d: linededup.dedup_lines(d),
    "merkle": lambda d: merkle.proofs(merkle.manifest(d)),
    "classifier": lambda d: classifier.classify(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "text AS label")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_table(spark, hostile, name):
    rows = OPERATORS[name](hostile).collect()
    assert len(rows) == hostile.count()
    assert OPERATORS[name](hostile.limit(0)).collect() == []
    nulls = hostile.select(*[corpus_pipeline.F.lit(None).cast(f.dataType).alias(f.name) for f in hostile.schema])
    assert len(OPERATORS[name](nulls).collect()) == hostile.count()


def test_filter_audit_of_a_hostile_table(spark, hostile):
    labels = hostile.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "1 AS toxic", "source AS part")
    nulls = hostile.select(*[corpus_pipeline.F.lit(None).cast(f.dataType).alias(f.name) for f in hostile.schema])
    for docs in (hostile, nulls):
        rows = filteraudit.audit(docs, labels).collect()
        parts = {r.source or "" for r in docs.collect()}
        assert len(rows) == 600 * len(parts) and {r.part for r in rows} == parts
        for order in ("ABCDE", "EDCBA"):
            assert sum(r.kept + r.removed for r in rows if r.filter_order == order and r.step == 1) == docs.count()


def _folder(spark, tables):
    path = shared_path(spark, "test-tables")
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return path


def test_stages_on_a_hostile_table(spark, hostile, benchmark):
    folder = _folder(spark, {"documents": hostile, "benchmark": benchmark})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.source_mix(spark, docs, folder)  # it has a column `size` of its own
    assert len(last.columns) == len(set(last.columns)) and last.count() == docs.count() > 0
    last.write.parquet(shared_path(spark, "hostile-mix"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), folder).collect()


def test_each_stage_takes_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "benchmark_decontamination", "source_mix"]
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    ids = [r.doc_id for r in docs.collect()]
    first = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert first.columns == columns and first.count() > 0.97 * len(ids)
    second = corpus_pipeline.line_dedup(spark, first, SF).cache()
    texts = [r.text for r in second.collect()]
    assert second.columns == columns and all(r.n_chars == len(r.text) for r in second.collect())
    passages = [line for t in texts for line in t.split("\n") if len(line.split()) > 50]
    assert len(passages) - len(set(passages)) <= 2  # repeats within a document may stay
    third = corpus_pipeline.simhash_dedup(spark, second, SF).cache()
    fps = [simhash.text_fingerprint(r.text.encode()) for r in third.collect()]
    assert third.columns == columns and len(set(fps)) == len(fps)
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    fourth = corpus_pipeline.benchmark_decontamination(spark, third, SF).cache()
    found = decontaminate.contamination(third, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert found > 0 and fourth.count() == third.count() - found and fourth.columns == columns
    last = corpus_pipeline.source_mix(spark, fourth, SF).collect()
    assert len(last) == fourth.count() and all(r.taken == r.size * r.repeats <= 3 * r.size for r in last)
    before = {r.doc_id: r.taken for r in last}
    assert before == {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
