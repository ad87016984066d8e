"""Token counts without token ids.

The text is cut into pre-tokens that the tokenizer's merges never cross; a
pre-token's pieces are then the same in every text, so they are counted once per
distinct pre-token of the corpus and a text's count is the sum of its pre-token
frequencies times those counts.

Cuts for a SentencePiece BPE model (checked against its vocabulary when it is
loaded): no piece has a word mark after another character, so a run of spaces
begins a pre-token; no piece holds a line feed, so a line feed stands alone.
The first pre-token of a text carries the mark that the model puts before a text.

Frequent pre-tokens (at most ``head`` of them, found from the counted
vocabulary) are summed where the text is read; the rest is joined with the
vocabulary by pre-token, so a text sends only its rare pre-tokens.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
each get a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import map_arrow, shared_table

MODEL = "piece_bpe_32k.model"
#: Pre-tokens whose counts every task holds, at most.
HEAD = 1 << 18
#: Distinct pre-tokens a task gathers before it passes them on.
GATHER = 400_000
_CUT = re.compile(" *[^ \n]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@cache
def _processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    crossing = [p for p in pieces if re.search("[^▁]▁", p) or "\n" in p]
    if crossing or model.encode("  a  b") != model.encode("  a") + model.encode(" b")[0:] and \
            model.encode("  a  b", out_type=str) != model.encode("  a", out_type=str) + ["▁", "▁b"]:
        raise ValueError(f"pieces cross the cuts of this operator: {crossing[:5]}")
    return model


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a non-empty text but for its line feeds, one token each."""
    return _CUT.findall(" " + text.replace("▁", " "))


def piece_counts(tokens: list[str], model_path: str) -> list[int]:
    """Number of pieces of each pre-token. The model puts its word mark before
    every input: it replaces a pre-token's first space, and one without a space
    (after a line feed) is read behind a line feed, whose two pieces are taken off."""
    model = _processor(model_path)
    asked = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
    got = model.encode([x or "a" for x in asked], num_threads=1)
    return [1 if not x else len(g) - (x[0] == "\n" and t[0] != " ") * 2 for t, x, g in zip(tokens, asked, got)]


def vocabulary(docs: DataFrame, model_path: str) -> DataFrame:
    """Distinct pre-tokens of (text): token, n (occurrences), pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(pre_tokens(t))
                    if len(seen) > GATHER:
                        yield from _counted(seen)
                        seen = Counter()
        yield from _counted(seen)

    def _counted(seen):
        tokens, n = list(seen), list(seen.values())
        for k in range(0, len(tokens), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[k:k + 50_000], pa.string()), pa.array(n[k:k + 50_000], pa.int64())], ["token", "n"])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(piece_counts(b.column(0).to_pylist(), model_path), pa.int32())], ["token", "n", "pieces"])

    return (docs.select(F.col("text").cast("string")).transform(map_arrow, gather, "token string, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).transform(map_arrow, tokenise, "token string, n long, pieces int"))


def _head_floor(words: DataFrame, head: int) -> int:
    """Least occurrences that at most ``head`` pre-tokens have."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"))
    total, floor = 0, 1 << 62
    for r in steps.orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        total += r.many
        if total > head:
            break
        floor = r.least
    return floor


def token_counts(docs: DataFrame, model_path: str | None = None, head: int = HEAD) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_bytes, n_tokens), a row per row."""
    model_path = model_path or default_model()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = shared_table(vocabulary(docs.select("text"), model_path), "pre-tokens")
    floor = _head_floor(words, head)
    frequent = words.where(F.col("n") >= floor).select("token", "pieces").toArrow()  # bounded by head
    known = dict(zip(frequent.column("token").to_pylist(), frequent.column("pieces").to_pylist()))
    schema = "row long, mark long, token string, n int, doc_id long, n_bytes long"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40  # the task's rows come in a fixed order
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, (id_, t) in enumerate(zip(ids, texts)):
                row += 1
                sure = 0
                if t:
                    sure = t.count("\n")
                    for token, n in Counter(pre_tokens(t)).items():
                        pieces = known.get(token)
                        if pieces is None:
                            out.append((row, 0, token, n, None, None))
                        else:
                            sure += pieces * n
                # a row of its own, whose mark keeps it apart from all pre-tokens
                out.append((row, row, "", sure, id_, len((t or "").encode())))
                if len(out) > 50_000 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), types)], schema.replace(",", "").split()[::2])
                    out = []

    rest = words.where(F.col("n") < floor).select(F.lit(0).cast("long").alias("mark"), "token", "pieces")
    found = docs.transform(map_arrow, frequencies, schema).join(rest, ["mark", "token"], "left")
    return found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")).drop("row")
