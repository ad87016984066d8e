"""Winnowing against an exhaustive search of windows."""

import random

import numpy as np
import pytest

from trellis.llm import decontaminate as D


def exhaustive(text, items, span=10):
    words = D.words_of(text.encode() if text is not None else None)
    hit, names = set(), set()
    for name, item in items:
        iw = D.words_of(item.encode() if item is not None else None)
        n = min(span, len(iw))
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p:p + n]) in windows:
                hit.update(range(p, p + n))
                names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(200):
        ids = rng.integers(1, 6, 40)
        at, length = int(rng.integers(0, 20)), 10
        other = np.concatenate((rng.integers(1, 6, int(rng.integers(0, 9))), ids[at:at + length], rng.integers(1, 6, 5)))
        a, b = D.gram_hashes(ids, 5), D.gram_hashes(other, 5)
        assert set(a[D.winnowed(a, 6)].tolist()) & set(b[D.winnowed(b, 6)].tolist())


@pytest.mark.parametrize("block_words,scan_words", [(1_000_000, 1 << 20), (40, 50)])
def test_equals_exhaustive_search(spark, monkeypatch, block_words, scan_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(D, "SCAN_WORDS", scan_words)
    rng = random.Random(3)
    word = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(word, k=rng.choice([1, 3, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(100, items[5][1]), (101, None), (102, " .,- "), (None, "only this odd short item"), (7, "a repeated id with a different text of more than ten words here")]
    docs = []
    for i in range(120):
        text = rng.choices(word + ["zz"], k=rng.choice([0, 2, 9, 30, 80]))
        if i % 3 == 0:
            other = rng.choice(items[:30])[1].split()
            at = rng.randrange(len(other))
            text[len(text) // 2:len(text) // 2] = other[at:at + rng.choice([9, 10, 15])]
        docs.append((i, " ".join(text).replace("w1 ", "W1--")))
    docs += [(500, None), (501, ""), (502, "Only this, odd SHORT item!"), (None, items[8][1]), (5, docs[5][1]), (503, "x " * 3000 + items[9][1])]
    left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int").repartition(3)
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    key = lambda x: (x[0] is not None, x)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in D.contamination(left, right).collect()), key=key)
    want = sorted(((i, *(e := exhaustive(t, items)), e[1] > 0) for i, t in docs), key=key)
    assert got == want
    clean = D.remove_contaminated(left, right)
    assert clean.columns == left.columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == [w[0] for w in want if not w[4] and w[0] is not None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).first().contaminated is False
    assert D.contamination(docs, items).first().n_hit == 2
