import math
import re
import zlib
from collections import Counter

import numpy as np

from trellis.llm import classifier as C

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.1"


def counted(text):
    words = TOKEN.findall(text or b"")
    return Counter(words) + Counter(("=",) if a == b else (a, b) for a, b in zip(words, words[1:]))


def features(texts):
    doc, bucket, count = C.ngrams(texts)
    return doc, bucket, C.values(doc, count, len(texts))


TEXTS = [None, b"", b" \n\t", b"one", b"a a a b", b"The cat*** sat!! on | the mat", "é ü\U0001F600 é".encode(), b"x" * 5000, b"***!!!", b"a b\x00c\x1cd", b"a b a b a"]


def test_features_equal_counted_ngrams():
    doc, bucket, value = features(TEXTS)
    for i, t in enumerate(TEXTS):
        want = counted(t)
        got = sorted(value[doc == i])
        values = [1 + math.log(n) for n in want.values()]
        length = math.sqrt(sum(v * v for v in values))
        assert np.allclose(got, sorted(v / length for v in values)), t
    assert len(set(zip(doc, bucket))) == len(doc)


def test_equal_ngrams_share_a_bucket():
    doc, bucket, _ = features([b"red fish", b"pad pad red fish", b"no no", b"red\nfish!"])
    at = [set(bucket[doc == i]) for i in range(4)]
    assert at[0] <= at[1] and at[0] < at[3]
    assert len(at[1] & at[2]) == 1  # a repeated word is one feature, whatever the word


def test_long_texts_are_counted_whole():
    piece, C_PIECE = (b"red fish swim on and on ! " * 100), C.PIECE
    whole = features([piece, b"x y"])
    try:
        C.PIECE = 64
        cut = features([piece, b"x y"])
        one = features([b"q" * 1000 + b" red fish", b"x y"])
    finally:
        C.PIECE = C_PIECE
    for a, b in zip(whole, cut):
        assert np.allclose(a, b)
    for a, b in zip(features([b"q" * 1000 + b" red fish", b"x y"]), one):
        assert np.allclose(a, b)


def test_updates_equal_the_textbook_recursion():
    rng = np.random.default_rng(1)
    z, n, zs, ns = np.zeros(6), np.zeros(6), [0.0] * 6, [0.0] * 6
    for _ in range(200):
        at = rng.choice(6, 3, replace=False)
        x, y = rng.random(3), float(rng.random() < 0.5)
        w = [0.0 if abs(zs[i]) <= C.L1 else -(zs[i] - math.copysign(C.L1, zs[i])) / ((C.BETA + math.sqrt(ns[i])) / C.ALPHA + C.L2) for i in at]
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(a * b for a, b in zip(w, x))))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            sigma = (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / C.ALPHA
            zs[i] += g - sigma * wi
            ns[i] += g * g
        C.update(z, n, at, x, y)
    assert np.allclose(z, zs) and np.allclose(n, ns)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r.score for r in C.classify(docs, labels).selectExpr("row.doc_id", "score").collect()}
    marks = [(r.quality, found[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(found) == docs.count() and all(0 <= s <= 1 for s in found.values())
    good, bad = [s for q, s in marks if q == 1], [s for q, s in marks if q == 0]
    assert sum(s >= 0.3 for s in good) > 0.99 * len(good)
    assert sum(s < 0.3 for s in bad) > 0.9 * len(bad)


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.i: r.score for r in C.classify(documents, x).selectExpr("row.doc_id AS i", "score").collect()} for x in (labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_edges(spark):
    schema = "doc_id long, text string, score double, label string, at int, shard int"
    docs = spark.createDataFrame([(1, "good text", 0.0, "l", 1, 1), (1, "good text", 0.0, "l", 1, 1), (None, "bad ***", 0.0, None, 1, 1), (2, None, 0.0, "l", 1, 1),
                                  (3, "", 0.0, "l", 1, 1), (4, "bad *** " * 30_000, 0.0, "l", 1, 1)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (4, 0, 0), (4, 0, 1), (None, 0, 0), (2, 1, 1)], "doc_id long, quality int, label int")
    rows = C.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0].row.label in ("l", None)
    twice = [r.score for r in rows if r.row.doc_id == 1]
    empty = [r.score for r in rows if r.row.doc_id in (2, 3)]
    assert twice[0] == twice[1] and empty[0] == empty[1]
    assert {r.score for r in C.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert C.classify(docs.limit(0), labels).collect() == []


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert 0 < C.training_rows(docs, labels, 100).count() < 250
