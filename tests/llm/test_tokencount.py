"""Token counts against the library on whole texts."""

import random

import pytest
import sentencepiece

from trellis.llm import tokencount as T

TEXTS = [None, "", " ", "\n", "\n\n a", "a\nb", "  x  y \n z ", "▁▁a ▁b", "\r\n;\r\n x\r", "\x00 a\t\tb", "日本語 テキスト", "a" * 5000, "<s> </s> <unk> <0x0A>",
         "é é ﬁ", " " * 100, "\n \n  \n", "x\n", "a\xa0b c", "word " * 20_000, "👍🏽 \U0001F1E6", "The The the"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=T.default_model())


@pytest.mark.parametrize("head", [0, 3, 1 << 18])
def test_whole_texts(spark, library, head):
    rng = random.Random(head)
    texts = TEXTS + ["".join(rng.choices("ab \n▁é;\r'", k=rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, token string, row int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.token_counts(docs, head=head).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}


def test_documents(spark, library, documents):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.token_counts(documents, head=2000).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in documents.collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = T.token_counts(docs).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 2), (False, 2), (True, 2)]
    assert T.token_counts(docs.limit(0)).count() == 0
