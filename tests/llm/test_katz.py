"""Katz back-off against a direct evaluation of the same definition."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trellis.llm import katz

TEXTS = ["the cat sat on the mat", "the cat sat", "A dog the DOG the dog sat", "", None, "  \n\t ", "the the the the the the the the",
         "unique words here only", "the cat\x0bsat on unique ground"] + ["common pair again"] * 9 + [f"the w{i % 7} w{i % 3} sat" for i in range(60)]


def direct(texts, train):
    """Scores by recursion over each text's tokens."""
    words = [katz.words_of(t.encode() if t is not None else None) for t in texts]
    uni, bi = Counter(), Counter()
    for w, on in zip(words, train):
        if on:
            uni.update(w + ["</end>"])
            bi.update(zip(["<start>"] + w, w + ["</end>"]))
    n, v, docs = sum(uni.values()), len(uni), sum(train)
    ustars, bstars = katz.discounted(Counter(uni.values())), katz.discounted(Counter(bi.values()))

    def star(c, stars):
        return stars[c] if c <= katz.LARGE else c - katz.LOSS

    unknown = 1 - sum(star(c, ustars) for c in uni.values()) / n if n else 1.0

    def p1(w):
        return star(uni[w], ustars) / n if uni[w] else unknown

    history, after = Counter(), defaultdict(list)
    for (h, w), c in bi.items():
        history[h] += c
        after[h].append((w, c))

    def p2(w, h):
        if not history[h]:
            return p1(w)
        if bi[h, w]:
            return star(bi[h, w], bstars) / history[h]
        rest = 1 - sum(star(c, bstars) for _, c in after[h]) / history[h]
        return rest / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    out = []
    for w in words:
        seq = w + ["</end>"]
        out.append((len(seq), sum(uni[x] > 0 for x in seq), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in seq),
                    sum(math.log10(p2(x, h)) for h, x in zip(["<start>"] + w, seq))))
    for h in history:  # every history sums to one
        total = sum(p2(w, h) for w in uni) + p2(b" unknown", h)
        assert abs(total - 1) < 1e-9
    return out


@pytest.mark.parametrize("head,hot", [(1 << 18, 1 << 16), (5, 3), (0, 0)])
def test_scores_match_the_recursion(spark, head, hot, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET", 60)
    monkeypatch.setattr(katz, "CHUNK_DOCS", 7)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    scored, model = katz.learn_and_score(docs, head, hot)
    rows = scored.collect()
    names = {r.id: bytes(r.word) for r in model.words.collect()} | {katz.START: "<start>", katz.END: "</end>"}
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(TEXTS))]
    want = direct(TEXTS, train)
    assert len(rows) == len(TEXTS) and 0 < sum(train) < len(TEXTS)
    words = [katz.words_of(t.encode() if t else None) for t, on in zip(TEXTS, train) if on]
    bigrams = Counter(p for w in words for p in zip(["<start>"] + w, w + ["</end>"]))
    assert {(names[r.h], names[r.w]): r.n for r in model.bigrams.collect()} == bigrams
    assert {r.id: r.n for r in model.words.where("n > 0").collect()} == {
        i: n for i, x in names.items() if (n := sum(w.count(x) for w in words))}
    for r in rows:
        n_tokens, n_known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (n_tokens, n_known, n, train[r.doc_id])
        assert np.isclose(r.base_score, base) and np.isclose(r.score, score), (r, want[r.doc_id])


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk string")
    assert katz.score(empty).count() == 0
    nobody = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2)], "doc_id long, text string, row int")
    rows = katz.score(nobody).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in rows] == [(None, 3, 0, 0, 0.0, 0.0)] * 2


def test_held_out_texts_gain_over_the_base(spark, documents):
    rows = katz.score(documents).collect()
    held = [r for r in rows if not r.train]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_copies_take_part_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(katz, "SAMPLE_DOCS", 60)
    rows = [(i, f"copied text{i % 3}" if i % 5 < 3 else f"own{i} words{i}") for i in range(1500)]  # three texts, 300 copies each
    texts = katz._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    found = katz._proposed(texts, 1 << 16)
    assert {(b"copied", b"text%d" % k) for k in range(3)} <= set(found)


@pytest.mark.parametrize("hot", [0, 1 << 16])
def test_counts_above_32_bits(spark, monkeypatch, hot):
    times = 3_000_000_000
    real = katz._counts
    monkeypatch.setattr(katz, "_counts", lambda *a: real(*a).withColumn("n", katz.F.col("n") * times))
    docs = spark.createDataFrame([(i, f"common words here number{i % 4} common words") for i in range(30)], "doc_id long, text string")
    scored, model = katz.learn_and_score(docs, hot=hot)
    rows = scored.collect()
    assert len(rows) == 30 and all(r.train_tokens > 1 << 31 and np.isfinite(r.score) for r in rows)
    assert model.words.agg(katz.F.max("n")).first()[0] > 1 << 31
    assert dict(model.bigrams.dtypes)["n"] == "bigint" and (not hot or model.bigrams.agg(katz.F.max("n")).first()[0] > 1 << 31)
    assert all(kind == "array<bigint>" for name, kind in (x.split() for x in katz._BACK.replace(katz._DOC_SQL, "x").split(", ")) if name in ("c", "wc", "uc", "n"))
