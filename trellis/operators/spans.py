"""Corpus-wide verbatim span search (E5 over whole tables).

``contains(doc, span)`` for every (document, span) pair is a theta join. Here the
distinct spans become multi-pattern automata (Aho-Corasick), and every document runs
through an automaton once: all spans in one pass over its raw text, whatever their
length, without tokens, gram indexes or a verification join.

Spans come in blocks of about ``BLOCK_CHARS`` characters, dealt by hash, so what a
task holds is bounded however many spans there are; the documents are scanned once
for each block. A scan shuffles nothing: it emits the pairs it found, a span as a pair
of 64-bit hashes, which then meet the items that ask for it (items with equal spans,
however many, are one pattern).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from trellis.session import ship_package

#: Characters of the spans of one block.
BLOCK_CHARS = 8_000_000

_LAST: dict[str, object] = {}


def _automaton(key: str, spans: pa.Array):
    """The automaton of a block: built once per Python worker that meets the block."""
    if key not in _LAST:
        from ahocorasick import Automaton

        found = Automaton()
        for i, s in enumerate(spans.to_pylist()):
            found.add_word(s, i)
        found.make_automaton()
        _LAST.clear()  # one block at a time
        _LAST[key] = found
    return _LAST[key]


def _blocks(spans: DataFrame, block_chars: int) -> Iterator[pa.Table]:
    """The rows of ``spans`` (span, _h, _g) in blocks of bounded size."""
    size = spans.agg(F.coalesce(F.sum(F.length("span") + 1), F.lit(0)).alias("n")).head().n
    n = -(-size // block_chars)
    for k in range(n):
        yield (spans if n == 1 else spans.where(F.pmod("_g", F.lit(n)) == k)).toArrow()


def _scan(docs: DataFrame, block: pa.Table) -> DataFrame:
    """``docs`` (key, text) to (key, _h, _g): the block's spans that each text holds."""
    spans, h, g = (block.column(c).combine_chunks() for c in ("span", "_h", "_g"))
    key_field = docs.schema.fields[0]
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(mark, spans)
        for b in batches:
            rows: list[int] = []
            hits: list[int] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    own = {k for _, k in find.iter(text)}
                    rows += [i] * len(own)
                    hits += own
            at = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), h.take(at), g.take(at)], [key_field.name, "_h", "_g"])

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, Ty.StructType([key_field, *Ty.StructType.fromDDL("_h long, _g long").fields]))


def corpus_contains(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str,
                    item_key: str, span: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All ``(item_key, doc_key)`` with ``doc_text`` containing ``span`` verbatim;
    a null or empty span has no hits, and neither has a null text."""
    both = [F.xxhash64(F.lit(k), F.col(span)).alias(c) for k, c in enumerate(("_h", "_g"))]
    asked = items.where(F.col(span) != "").select(item_key, F.col(span).cast("string").alias("span"), *both)
    texts = docs.select(doc_key, F.col(doc_text).cast("string").alias("text"))
    found = None
    for block in _blocks(asked.select("span", "_h", "_g").distinct(), block_chars):
        if not block.num_rows:
            continue
        hits = _scan(texts, block)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return asked.select(item_key).join(texts.select(doc_key), F.lit(False))
    return found.join(asked.select(item_key, "_h", "_g"), ["_h", "_g"]).select(item_key, doc_key)
