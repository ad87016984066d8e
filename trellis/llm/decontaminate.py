"""Benchmark decontamination by winnowing.

Words are interned against the benchmark's vocabulary; a word the benchmark does
not have becomes zero, which no shared span crosses. Of each ``window``
consecutive k-gram hashes the smallest is kept as a fingerprint, on both sides.
A span of ``k + window - 1`` shared words fills a whole window on either side
with the same hashes, so both keep the same k-gram: every shared span of at least
``span = k + window - 1`` words has a common fingerprint. Common fingerprints are
then extended word by word in both directions, which also removes hash
collisions, and the span counts when it holds a whole window of the item: ``span``
words, or the whole item where it is shorter (those items are looked up by their
full length, one hash per length).

The benchmark is a stated query set: it is dealt into blocks of a bounded number
of words, and each block's index goes to all documents in turn. Documents are
never shuffled unless there are several blocks.

Defined results: null, empty or word-less documents have no hits; word-less items
never occur; items with equal texts all count; a null item_id is listed as an
empty string; an empty benchmark leaves all documents clean; repeated rows each
get a row; extra columns are ignored by :func:`contamination` and kept by
:func:`remove_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import ALNUM_BYTES, map_arrow, shared_table, with_row

#: Words of the benchmark in one broadcast index.
BLOCK_WORDS = 1_000_000
#: Words of documents that are scanned together.
SCAN_WORDS = 1 << 17
_M1, _M2, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased UTF-8 text."""
    return (text or b"").translate(ALNUM_BYTES).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive ids; the largest value where one of them is 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed, out, bad = _mix(ids.astype(np.uint64) * _C), np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(k):
        out = out * _M1 + mixed[j:j + n]
        bad |= ids[j:j + n] == 0
    out = _mix(out) >> np.uint64(1)
    out[bad] = _NONE
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the smallest hash (the last of equal ones) of a window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        other = hashes[j:j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[best != _NONE])


class Index:
    """Fingerprints of one block of items (bounded by BLOCK_WORDS)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int, k: int):
        self.span, self.k, self.window = span, k, span - k + 1
        self.vocabulary: dict[bytes, int] = {}
        same: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            if words:
                ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
                same.setdefault(ids, []).append(name)
        self.names = list(same.values())
        self.ids = [np.array(x, np.int64) for x in same]
        long_: list[tuple[int, int, int]] = []
        short: dict[int, list[tuple[int, int, int]]] = {}
        for i, ids in enumerate(self.ids):
            if len(ids) >= span:
                h = gram_hashes(ids, k)
                long_ += [(int(h[p]), i, int(p)) for p in winnowed(h, self.window)]
            else:
                short.setdefault(len(ids), []).append((int(gram_hashes(ids, len(ids))[0]), i, 0))
        #: (k, window, sorted distinct hashes, posting lists)
        self.tables = [self._table(k, self.window, long_)] if long_ else []
        self.tables += [self._table(n, 1, rows) for n, rows in sorted(short.items())]

    @staticmethod
    def _table(k, window, rows):
        lists: dict[int, list[tuple[int, int]]] = {}
        for h, i, p in rows:
            lists.setdefault(h, []).append((i, p))
        return k, window, np.array(sorted(lists), np.uint64), lists

    def spans(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, stop, item) of every span that holds a whole window of an item."""
        for k, window, keys, lists in self.tables:
            hashes = gram_hashes(ids, k)
            at = winnowed(hashes, window) if window > 1 else np.flatnonzero(hashes != _NONE)
            if not len(at):
                continue
            found = np.searchsorted(keys, hashes[at])
            found[found == len(keys)] = 0
            at = at[keys[found] == hashes[at]]
            done: dict[tuple[int, int], int] = {}  # (item, diagonal): where its last span stops
            for p in at.tolist():
                for i, q in lists[int(hashes[p])]:
                    if done.get((i, p - q), -1) > p:
                        continue
                    item = self.ids[i]
                    if not np.array_equal(ids[p:p + k], item[q:q + k]):
                        continue
                    back = min(p, q)
                    differ = np.flatnonzero(ids[p - back:p] != item[q - back:q])
                    start = p - (back - int(differ[-1]) - 1 if len(differ) else back)
                    ahead = min(len(ids) - p, len(item) - q)
                    differ = np.flatnonzero(ids[p:p + ahead] != item[q:q + ahead])
                    stop = p + (int(differ[0]) if len(differ) else ahead)
                    done[i, p - q] = stop
                    if stop - start >= min(self.span, len(item)):
                        yield start, stop, i


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """(row, n_words, spans, items) of each document for one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = index.vocabulary.get

        def flush(ids: list, sizes: list) -> tuple[list, list]:
            starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
            spans, items = [[] for _ in sizes], [set() for _ in sizes]
            for a, b, i in index.spans(np.array(ids, np.int64)):
                d = int(np.searchsorted(starts, a, "right")) - 1
                spans[d].append({"a": a - int(starts[d]), "b": b - int(starts[d])})
                items[d].update(index.names[i])
            return spans, [sorted(x) for x in items]

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes, ids, pending = [], [], []
            spans, items = [], []
            for t in range(len(texts)):
                words = words_of(texts[t].as_py())
                ids += [look(w, 0) for w in words]
                ids.append(0)
                sizes.append(len(words))
                pending.append(len(words))
                if len(ids) >= SCAN_WORDS:
                    s, i = flush(ids, pending)
                    spans, items, ids, pending = spans + s, items + i, [], []
            s, i = flush(ids, pending)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans + s, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                 pa.array(items + i, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return docs.transform(map_arrow, run, with_row(docs, "n_words long, spans array<struct<a:bigint,b:bigint>>, items array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """``docs`` (doc_id, text) and ``benchmark`` (item_id, text) to one row per
    document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (word
    positions [a, b) that hold a window), contaminated."""
    return _measured(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"),
                                 F.col("text").cast("string").alias("text")), benchmark, span, k).select("row.*", *_MEASURES)


_MEASURES = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def _measured(rows: DataFrame, benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """``rows`` (row struct, text) to (row, measures)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
                             F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    total = items.agg(F.sum(size)).first()[0] or 0  # characters; at least two to a word
    blocks = max(1, -(-int(total) // (2 * BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    if blocks > 1:
        rows = shared_table(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
        rows = rows.select(F.struct("at", "row").alias("row"), "text")
    out = None
    for n in range(blocks):
        got = [(r.name, words_of(r.text.encode() if r.text is not None else None))
               for r in items.where(block == n).collect()]
        scan = _scan(rows.select("row", "text"), Index(got, span, k))
        out = scan if out is None else out.unionByName(scan)
    if blocks > 1:  # one row per document and block: at most `blocks` rows meet
        out = out.groupBy(F.col("row.at").alias("at")).agg(
            F.first("row.row").alias("row"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(F.array_sort("spans"), start, lambda x, s: F.struct(
        F.greatest(x.stop, s.b).alias("stop"),
        (x.n + F.greatest(F.lit(0).cast("long"), s.b - F.greatest(x.stop, s.a))).alias("n")), lambda x: x.n)
    names = F.array_sort(F.array_distinct("items"))
    return out.select("row", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                      names.alias("items"), "spans", (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """The documents, all columns as they are, that hold no window of an item."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return _measured(rows, benchmark, span, k).where(~F.col("contaminated")).select("row.*")
