"""Language identification as multilingual mixture inference.

A document is a bag of letter trigrams, each drawn from one of the learned
languages; expectation-maximisation estimates the languages' proportions from the
trigram likelihoods. A set of languages is preferred over a smaller one only if
its log-likelihood is higher by more than a penalty per language, so noise does
not add languages. The prediction is the language with the largest share in the
selected set, the score its share.

Training counts trigrams per language on a sample of at most about
``sample_docs`` labelled documents per language (picked by a hash of id and text,
so that copies of a text take part in proportion);
that bounds the model's cost, the model itself is languages x BUCKETS counts.
Prediction sees the whole text of every document, in one pass without a shuffle.

Defined results: null, empty or letter-less texts, and all texts when nothing was
learned, are ``und`` with score 0; equal shares go to the language that sorts
first; repeated rows each get a row; an empty table gives an empty table; extra
columns are kept by :func:`identified` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import map_arrow, with_row

BUCKETS = 1 << 16
#: Bound of the labelled sample: documents per language, about.
SAMPLE_DOCS = 3000
UNDETERMINED = "und"
#: Trigrams overlap, so a document has a third as many independent draws.
OVERLAP = 3.0
#: Nats that each further language costs, times the logarithm of the draws.
PENALTY = 1.5
ROUNDS = 12
#: Code points of documents that are handled together.
SCAN_CHARS = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the letter trigrams of each text, sorted by
    document. Runs of other characters count as one space; a trigram's middle is a
    letter. Texts without a letter have none."""
    joined = "\n".join((t or "").lower() for t in texts)
    points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    lengths = np.fromiter((len((t or "").lower()) for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)  # the first line feed opens document 0
    owner = np.append(owner, len(texts) - 1)
    keep = letter | np.append(True, letter[:-1])
    points, owner, letter = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    if len(points) < 3:
        return (np.empty(0, np.int64),) * 3
    code = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (code >> np.uint64(48)).astype(np.int64)
    middle = letter[1:-1]
    key, count = np.unique(owner[1:-1][middle] * BUCKETS + bucket[middle], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about SCAN_CHARS characters each."""
    for b in batches:
        texts, start, size = b.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= SCAN_CHARS or i + 1 == len(texts):
                yield b.slice(start, i + 1 - start), texts[start:i + 1]
                start, size = i + 1, 0


def may_train(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """``docs`` (doc_id, text, lang) to trigram log-probabilities by language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").count()
    share = {r.lang: min(1.0, sample_docs / r["count"]) for r in sizes.collect()}  # one row per language
    if not share:
        return {}
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.element_at(
        F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part, texts in _portions(batches, 0):
            langs = part.column(1).to_pylist()
            doc, bucket, n = trigrams(texts)
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])[doc]
            for k, name in enumerate(names):
                at = own == k
                seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                seen[name] += np.bincount(bucket[at], n[at], BUCKETS).astype(np.int64)
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    counts = known.where(pick).select("text", "lang").transform(map_arrow, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model: dict[str, np.ndarray] = {name: np.zeros(BUCKETS) for name in sorted(share)}
    for r in counts.collect():  # bounded: languages x BUCKETS
        model[r.lang][r.bucket] = r.n
    for name, n in model.items():
        model[name] = np.log((n + 0.1) / (n.sum() + 0.1 * BUCKETS))
    return model


def _mixture(like: np.ndarray, n: np.ndarray, starts: np.ndarray, total: np.ndarray,
             open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over documents (segments of rows beginning at ``starts``): shares
    (documents x languages, zero where not ``open_``) and log-likelihoods."""
    sizes = np.diff(np.append(starts, len(n)))
    share = open_ / open_.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = np.repeat(share, sizes, axis=0) * like
        part *= (n / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    mix = (np.repeat(share, sizes, axis=0) * like).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mix), starts)


def infer(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have trigrams, their shares of the languages in the
    selected set), from ``trigrams`` and the model (languages x BUCKETS)."""
    ids, starts = np.unique(doc, return_index=True)
    logs, n = log_p[:, bucket].T, count.astype(float)
    total = np.add.reduceat(n, starts)
    like = np.exp(logs)
    alone = np.add.reduceat(n[:, None] * logs, starts, axis=0)
    share = np.zeros((len(ids), log_p.shape[0]))
    share[np.arange(len(ids)), alone.argmax(axis=1)] = 1
    if log_p.shape[0] == 1:
        return ids, share
    full, most = _mixture(like, n, starts, total, np.ones_like(share))
    cost = PENALTY * np.log(np.maximum(total / OVERLAP, 2))
    best = alone.max(axis=1) / OVERLAP
    # no set can do better than all languages together: where even that does not pay
    # for a second language, one is right
    many = np.flatnonzero(most / OVERLAP - cost > best)
    if len(many):
        sizes = np.diff(np.append(starts, len(n)))
        rows = np.repeat(np.isin(np.arange(len(ids)), many), sizes)
        like, n, sizes = like[rows], n[rows], sizes[many]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rank = np.argsort(np.argsort(-full[many], axis=1, kind="stable"), axis=1)
        for k in range(2, log_p.shape[0] + 1):
            found, ll = _mixture(like, n, starts, total[many], (rank < k).astype(float))
            value = ll / OVERLAP - (k - 1) * cost[many]
            better = value > best[many]
            best[many[better]] = value[better]
            share[many[better]] = found[better]
    return ids, share


def _predicted(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(row, text) to (row, lang_pred, score)."""
    names = sorted(model)
    log_p = np.stack([model[x] for x in names]) if names else np.zeros((0, BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _portions(batches, 1):
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            doc, bucket, count = trigrams(texts)
            if len(doc) and names:
                ids, share = infer(doc, bucket, count, log_p)
                lang[ids] = np.array(names, object)[share.argmax(axis=1)]
                score[ids] = np.clip(share.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return rows.transform(map_arrow, run, with_row(rows, "lang_pred string, score double"))


def identified(docs: DataFrame, training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (row: all their columns, lang_pred, score),
    learned from ``training`` (doc_id, text, lang) as :func:`may_train` allows."""
    model = learn(training.where(may_train(F.col("doc_id"))), sample_docs)
    return _predicted(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), model)


def accepted(docs: DataFrame, training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents, columns as they are, for which a language can be determined;
    mixtures of languages are among them, however small the largest share."""
    found = identified(docs, training, sample_docs)
    return found.where(F.col("lang_pred") != UNDETERMINED).select("row.*")
