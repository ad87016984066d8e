"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-Proximal) updates.

A word is a run of letters and digits, or a run of other visible characters. The
features of a text are its words and pairs of neighbouring words, hashed to
``BUCKETS``; a pair of equal words is one feature, whatever the word. A feature's
value is 1 + log(count), scaled so that the text's values have length one, so long
and short texts weigh alike. A score is the sigmoid of a sparse dot product.

Learning reads at most about ``sample_rows`` labelled rows (all where there are
fewer), picked by hash: the ids first, so that the labels reach the documents as a
bounded broadcast, then the rows, so that a repeated id cannot fill the sample. Their
features are a written table of about ``SHARDS`` parts, which every round reads without
a shuffle: each part goes on from the common state with its own updates, row by row,
and the parts' states are averaged by their rows; a state has two numbers a bucket.
Scoring is one pass over all whole texts without a shuffle.

Defined results: a null text, an empty one and one without words have no features and
score the model's bias; a null ``doc_id`` is not learned from; where an id has several
labels their mean is learned; null labels count for nothing; without any label all
scores are 0.5; repeated rows each get the same score; very long texts are hashed
piece by piece and counted whole; an empty table gives an empty table; other columns
stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import map_arrow, shared_table, with_row

#: Hashed features; the bias has a place after them.
BUCKETS = 1 << 17
#: Labelled rows that are learned from, about, and the parts they make.
SAMPLE_ROWS, SHARDS = 24_000, 8
#: Rounds over the sample.
ROUNDS = 6
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.02, 0.0
#: Bytes hashed at once.
PIECE = 1 << 20

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letter or digit, 2: other
_KIND[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = 1
_KIND[np.r_[0x20, 0x09:0x0E]] = 0
_BASE = 0x9E3779B97F4A7C15
_REPEAT = np.uint64(0xD1B54A32D192ED03)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of ``text``: equal words have equal hashes."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)) != 0)
    start, end = edge[:-1], edge[1:]
    if not len(start):
        return start, np.empty(0, np.uint64)
    word = kind[start] != 0
    start, end = start[word], end[word]
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])))
    return start, _mixed((sums[end] - sums[start]) * inverse[start])


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n"))
        if cut <= at:  # one word: to its end
            ends = [x for x in (text.find(c, at + PIECE) for c in (b" ", b"\n")) if x >= 0]
            cut = min(ends) if ends else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, bucket, count) of the texts' features, in order."""
    docs, words = [], []
    few, size, begun = [], 0, 0

    def short() -> None:
        """Short texts are hashed together, a line feed after each."""
        if few:
            ends = np.cumsum([len(t) + 1 for t in few])
            start, h = word_hashes(b"\n".join(few) + b"\n")
            docs.append(begun + np.searchsorted(ends, start, "right"))
            words.append(h)
            few.clear()

    for i, t in enumerate(texts):
        t = t or b""
        if few and size + len(t) > PIECE:
            short()
        if not few:
            begun, size = i, 0
        if len(t) <= PIECE:
            few.append(t)
            size += len(t) + 1
        else:
            for piece in _pieces(t):
                h = word_hashes(piece)[1]
                docs.append(np.full(len(h), i))
                words.append(h)
    short()
    doc, word = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((docs, np.int64), (words, np.uint64)))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = word[pair], word[pair + 1]
    pairs = np.where(a == b, _REPEAT, _mixed(a * np.uint64(3) + b))
    bucket = np.concatenate((word, pairs)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    key, count = np.unique(np.concatenate((doc, doc[pair])) * BUCKETS + bucket.astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def values(doc: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The features' values, of texts numbered below ``n``."""
    value = 1 + np.log(count)
    return value / np.sqrt(np.bincount(doc, value * value, n))[doc]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the state (z, n) stands for."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def update(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, label: float) -> None:
    """One row's step: ``at`` its features (the bias among them), ``value`` theirs."""
    zs, ns = z[at], n[at]
    w = weights(zs, ns)
    g = (sigmoid(float(w @ value)) - label) * value
    more = ns + g * g
    z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
    n[at] = more


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about PIECE bytes of text each."""
    for b in batches:
        texts, start, size = b.column(column).cast(pa.binary()), 0, 0
        part: list[bytes | None] = []
        for i in range(b.num_rows):
            part.append(texts[i].as_py())
            size += len(part[-1] or b"")
            if size >= PIECE or i + 1 == b.num_rows:
                yield b.slice(start, i + 1 - start), part
                part, start, size = [], i + 1, 0


def may_train(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is not 0 modulo 5."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def _share(rows: int, bound: int) -> int:
    """Of a million, so many keep about ``bound`` of ``rows``."""
    return int(min(1.0, bound / max(1, rows)) * 1_000_000)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(shard, at: order, label, bucket and value arrays) of a bounded sample of the
    labelled documents, as a written table."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(may_train(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.avg("quality").alias("label"))

    def picked(h: Column, rows: int) -> Column:
        return F.pmod(h, F.lit(1_000_000)) < _share(rows, sample_rows)

    marks = shared_table(marks.where(picked(F.xxhash64("doc_id"), marks.count())), "quality-labels")  # about sample_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), "doc_id")
    order = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    rows = rows.withColumn("at", order).where(picked(F.col("at"), rows.count()))

    rows = rows.select("at", "label", "text", F.pmod("at", F.lit(SHARDS)).alias("shard")).repartition(SHARDS, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _portions(batches, 2):
            doc, bucket, count = ngrams(texts)
            stops = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(stops, pa.array(bucket, pa.int32())),
                 pa.ListArray.from_arrays(stops, pa.array(count, pa.int32()))], ["at", "label", "bucket", "count"])

    return shared_table(rows.transform(map_arrow, run, "at long, label double, bucket array<int>, count array<int>"), "quality-sample")


def _round(z0: np.ndarray, n0: np.ndarray, seed: int):
    """One part's updates from the common state, as a function of its rows: the state
    times the number of rows, and (at -1) that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]  # a bounded part of the sample
        if not part:
            return
        table = pa.Table.from_batches(part)
        z, n = z0.copy(), n0.copy()
        ats, labels = table.column("at").to_numpy(), table.column("label").to_numpy()
        buckets, counts = table.column("bucket").combine_chunks(), table.column("count").combine_chunks()
        for i in np.lexsort((ats, ats * (2 * seed + 1) % 1009)):  # another order in each round
            at, count = buckets[int(i)].values.to_numpy(), counts[int(i)].values.to_numpy()
            value = values(np.zeros(len(at), np.int64), count, 1)
            update(z, n, np.append(at, BUCKETS), np.append(value, 1.0), labels[i])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(z[at], 1) * len(ats), pa.float32()),
             pa.array(np.append(n[at], 1) * len(ats), pa.float32())], ["at", "z", "n"])

    return run


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the buckets, and the bias, from :func:`training_rows`."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(rounds):
        states = rows.transform(map_arrow, _round(z, n, k), "at int, z float, n float")
        total = states.groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()  # at most BUCKETS + 2 rows
        at, sums = total.column("at").to_numpy(), [total.column(c).to_numpy() for c in ("z", "n")]
        if not len(at):
            break
        size = sums[0][at < 0][0]
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        z[at[at >= 0]], n[at[at >= 0]] = (x[at >= 0] / size for x in sums)
    return weights(z, n)


def scored(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """``docs`` (text, ...) to (row: all its columns, score)."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    weight = weight.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _portions(batches, 1):
            doc, bucket, count = ngrams(texts)
            total = weight[BUCKETS] + np.bincount(doc, weight[bucket] * values(doc, count, len(texts)), len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(total), pa.float64())], ["row", "score"])

    return rows.transform(map_arrow, run, with_row(rows, "score double"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (row: all its columns, score: probability of
    label 1), learned from ``labels`` (doc_id, quality) as :func:`may_train` allows."""
    return scored(docs, train(training_rows(docs, labels, sample_rows), rounds))
