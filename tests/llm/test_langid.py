import numpy as np

from trellis.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.identified(docs, docs).selectExpr("row.doc_id", "row.lang", "lang_pred", "score", "row.text").collect()
    held = [r for r in found if (__import__("zlib").crc32(str(r.doc_id).encode()) % 3) == 1]
    assert len(found) == docs.count() and len(held) > 2000
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in found)


def test_mixture_finds_both_languages(spark, documents):
    model = langid.learn(documents.where(langid.may_train(documents.doc_id)))
    names = sorted(model)
    log_p = np.stack([model[n] for n in names])
    texts = {r.lang: r.text for r in documents.where("n_chars > 2000 AND n_chars < 3000").collect()}
    ids, share = langid.infer(*langid.trigrams([texts["en"] + "\n" + texts["de"], texts["fr"]]), log_p)
    both = dict(zip(names, share[0]))
    assert ids.tolist() == [0, 1] and both["en"] > 0.3 and both["de"] > 0.3 and both["fr"] == both["es"] == 0
    assert dict(zip(names, share[1]))["fr"] == 1


def test_trigrams_do_not_depend_on_the_batch():
    texts = ["Ab c", None, "", "12 !", "é", "Straße\nİx", "ab c"]
    doc, bucket, count = langid.trigrams(texts)
    for i, t in enumerate(texts):
        one = langid.trigrams([t])
        at = doc == i
        assert bucket[at].tolist() == one[1].tolist() and count[at].tolist() == one[2].tolist(), t
    assert set(doc.tolist()) == {0, 4, 5, 6}
    assert bucket[doc == 0].tolist() == bucket[doc == 6].tolist()


def test_learning_uses_text_and_language_only(spark, documents):
    a = langid.identified(documents, documents)
    b = langid.identified(documents.withColumn("source", langid.F.lit("x")).withColumn("n_chars", langid.F.lit(0)), documents)
    key = ["row.doc_id", "lang_pred", "score"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    # what is held out is never learned from
    spoiled = documents.withColumn("lang", langid.F.when(langid.may_train(documents.doc_id), documents.lang).otherwise(langid.F.lit("zz")))
    c = langid.identified(documents, spoiled)
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, c.select(*key).collect()))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "1 2 3 !", None, "a"), (None, "the words of it", "en", "b"), (3, "the words", "en", "c"),
            (3, "the words", "en", "c"), (5, "der die das und nicht " * 20, "de", "d"), (7, "the words of this " * 20, "en", "d"), (8, "x" * 200_000, None, "e")]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identified(docs, docs).selectExpr("row.doc_id", "row.text", "lang_pred", "score").collect()}
    assert got[1, None] == got[2, ""] == got[3, "1 2 3 !"] == ("und", 0.0)
    assert got[3, "the words"][0] == "en" and langid.identified(docs, docs).count() == len(rows)
    assert langid.accepted(docs, docs).columns == docs.columns
    assert sorted(r.doc_id for r in langid.accepted(docs, docs).collect() if r.doc_id in (1, 2)) == []
    untaught = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(docs, untaught).collect()} == {"und"}
    assert langid.identified(docs.limit(0), docs.limit(0)).count() == 0


def test_copies_take_part_in_the_sample(spark):
    rows = [(i, f"{'xyz' if i % 3 else 'uvw'} abc" if i % 4 else f"own {i}", "en") for i in range(4000)]  # two texts, 1500 copies or more together
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)

    def times(word):  # trigrams of the sample relative to those of "abc"
        logs = [np.exp(model["en"][langid.trigrams([x])[1]]).sum() for x in (word, "abc")]
        return logs[0] / logs[1]

    assert 0.45 < times("xyz") < 0.9 and 0.15 < times("uvw") < 0.55


def test_mixtures_are_accepted(spark, documents):
    texts = {r.lang: r.text for r in documents.where("n_chars > 2000 AND n_chars < 3000").collect()}
    mixed = "\n".join(texts[x][:2000] for x in ("de", "en", "fr"))
    docs = spark.createDataFrame([(1, mixed, None), (2, "1 2 3", None)], "doc_id long, text string, lang string")
    training = documents.select("doc_id", "text", "lang")
    score = langid.identified(docs, training).where("row.doc_id = 1").first().score
    assert score < 0.5  # no language has half of it
    assert [r.doc_id for r in langid.accepted(docs, training).collect()] == [1]
