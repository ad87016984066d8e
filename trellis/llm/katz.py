"""Katz back-off bigram model over words, learned and evaluated at corpus scale.

Tokens are the words of a text and one end. A seen bigram has the probability
r* / c(h): its Good-Turing discounted count over its history's count. The rest
of a history's mass goes to unseen words in proportion to their unigram
probability, P(w|h) = alpha(h) P(w), where alpha(h) is the discounted mass over
the unigram mass of the words not seen after h: every history sums to exactly one.
Unigrams are discounted likewise; their rest is the probability of the unknown
word, one event. Counts above LARGE lose a constant (the usual approximation of
Good-Turing there), so each history keeps mass for unseen words.

How it is laid out on Spark:

* Words are counted (pre-aggregated in the tasks) into a table. The frequent ones
  (at most HEAD) get small ids that every task knows; any other is its 64-bit hash.
  Words whose hashes collide join the frequent ones, so ids are unique.
* The most frequent bigrams (at most HOT, proposed by a bounded sample, counted
  over all training texts) are evaluated where the text is read. The sample is
  one of rows, so copies of a text take part in proportion, and no bigram is left
  that a large part of the documents hold, unless more than HOT are such.
* All other transitions are dealt to buckets: by their word where it is rare, else
  by their history, which is split by word in proportion to its count. A bucket
  holds all occurrences of its bigrams, and of its rare words; it counts them and
  sends each occurrence's count back to the chunk of documents it came from. The
  number of buckets grows with the corpus.
* Per history, the buckets' sums give alpha(h); frequent histories' weights
  go to all chunks, others are joined to the unseen transitions that need them.

The model's counts, weights and per-chunk counts are Parquet tables partitioned
by kind in the shared folder.

Defined results: a null, empty or blank text is one end; a document with a null
id is scored and not learned from; without training texts every token is the
unknown word with probability one (score 0); repeated rows each get a row; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import map_arrow, shared_path, shared_table

HEAD = 1 << 18
HOT = 1 << 16
#: Documents, about, of the sample that proposes frequent bigrams.
SAMPLE_DOCS = 4000
#: Counts up to here are discounted by Good-Turing; larger ones lose LOSS.
LARGE, LOSS = 5, 0.75
#: Transitions a bucket gets, about, and documents and tokens of a chunk at most.
BUCKET, CHUNK_DOCS, CHUNK_TOKENS = 800_000, 8192, 1_500_000
GATHER = 400_000
#: Entries of one row of the counts table.
PART = 100_000
#: Ids of a text's start and end, and their stand-ins among words (no word has a space).
START, END, FIRST = 0, 1, 2
MARKS = {b" start": START, b" end": END}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def marked(words: list[bytes]) -> list[bytes]:
    start, end = MARKS
    return [start, *words, end]


def learns(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text is not 0 modulo 10."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(False))


def discounted(of: dict[int, int]) -> np.ndarray:
    """r* for r = 0 .. LARGE from the numbers of types that occur r times."""
    out = np.arange(LARGE + 1, dtype=float)
    for r in range(1, LARGE + 1):
        turing = (r + 1) * of.get(r + 1, 0) / of[r] if of.get(r) else 0
        out[r] = turing if 0 < turing < r else r - LOSS
    return out


def lowered(counts: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """r* of each count."""
    return np.where(counts <= LARGE, stars[np.minimum(counts, LARGE)], counts - LOSS)


class Ids(dict):
    """Ids of words: the known small ones, else the hash (found once per chunk)."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        x = xxh64_intdigest(word, 42)  # as Spark's xxhash64
        self[word] = x = x - (1 << 64) if x >= 1 << 63 else x
        return x


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(values: np.ndarray, stops: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(values, kind))


# -- words and frequent bigrams --------------------------------------------------

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learns(F.col("doc_id")).alias("train"))


def _proposed(texts: DataFrame, hot: int) -> list[tuple[bytes, bytes]]:
    """Frequent bigrams of a bounded sample of the training texts."""
    train = texts.where("train")
    share = int(min(1.0, SAMPLE_DOCS / max(1, train.count())) * 1_000_000)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                w = marked(words_of(t))
                seen.update(zip(w, w[1:]))
        often = [(h, w, n) for (h, w), n in seen.items()]
        h, w, n = zip(*often) if often else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["h", "w", "n"])

    # by row, not by content: copies are neither all in the sample nor all out of it
    row = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    some = train.where(F.pmod(row, F.lit(1_000_000)) < share).select("text")
    found = some.transform(map_arrow, pairs, "h binary, w binary, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))
    top = found.where("n > 1").orderBy(F.desc("n"), "h", "w").limit(hot).toArrow()
    return list(zip(top.column("h").to_pylist(), top.column("w").to_pylist()))


def _counts(texts: DataFrame, proposed: list[tuple[bytes, bytes]]) -> DataFrame:
    """(word binary, pair int, n): training occurrences of every word of any text
    (pair -1), and of the proposed bigrams (pair: the bigram's place)."""
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for p in proposed for w in p}))}
    width = len(vocabulary) + 1
    codes = np.array([vocabulary[h] * width + vocabulary[w] for h, w in proposed], np.int64)
    order = np.argsort(codes)
    keys = codes[order]
    opens, closes = np.zeros(width, bool), np.zeros(width, bool)  # words that begin or end one
    opens[codes // width], closes[codes % width] = True, True

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set = set()
        pairs = np.zeros(len(keys), np.int64)

        def passed() -> Iterator[pa.RecordBatch]:
            rows = [*seen.items(), *((w, 0) for w in other if w not in seen)]
            for k in range(0, len(rows), 50_000):
                word, n = zip(*rows[k:k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array([-1] * len(n), pa.int32()), pa.array(n, pa.int64())], ["word", "pair", "n"])

        look, line = vocabulary.get, []

        def count_pairs() -> None:
            ids = np.array(line, np.int64)
            line.clear()
            both = np.flatnonzero(opens[ids[:-1]] & closes[ids[1:]])
            code = ids[both] * width + ids[both + 1]
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            pairs[:] += np.bincount(order[at[keys[at] == code]], minlength=len(keys))

        for b in batches:
            for t, train in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                if not train:
                    other.update(words)
                else:
                    seen.update(words)
                    if len(keys):
                        line += map(look, marked(words), repeat(0))
                        line.append(0)  # no pair across texts
                        if len(line) > GATHER:
                            count_pairs()
                if len(seen) + len(other) > GATHER:
                    yield from passed()
                    seen, other = Counter(), set()
        if line:
            count_pairs()
        yield from passed()
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([b""] * len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(pairs[some])], ["word", "pair", "n"])

    return texts.select("text", "train").transform(map_arrow, gather, "word binary, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))


class Totals:
    """Numbers of the training texts, and the unigram model they give."""

    def __init__(self, docs: int, tokens: int, types: int, of: dict[int, int], stars_sum: float):
        self.docs, self.tokens, self.types = docs, tokens, types
        self.stars = discounted(of)
        #: Probability of the unknown word.
        self.unknown = 1 - stars_sum / tokens if tokens else 1.0

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram probability of words with these counts."""
        p = lowered(counts, self.stars) / max(1, self.tokens)
        return np.log10(np.where(counts > 0, p, self.unknown))

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


class Words:
    """What every task knows: totals, frequent words and bigrams."""

    def __init__(self, texts: DataFrame, head: int, hot: int):
        proposed = _proposed(texts, hot)
        table = shared_table(_counts(texts, proposed).withColumn("id", F.xxhash64("word")), "words")
        words = table.where("pair < 0").select("word", "id", "n")
        docs = texts.where("train").count()
        many = {r.r: r for r in words.where("n > 0").groupBy(F.least("n", F.lit(LARGE + 2)).alias("r")).agg(
            F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()}  # LARGE + 2 rows
        of = {r: many[r].types for r in many if r <= LARGE + 1}
        if docs:
            of[docs] = of.get(docs, 0) + 1  # the end is a word too
        stars = discounted(of)
        kept = sum(r.types * stars[k] if k <= LARGE else r.tokens - LOSS * r.types for k, r in many.items())
        kept += float(lowered(np.array([docs]), stars)[0]) if docs else 0
        self.totals = Totals(docs, sum(r.tokens for r in many.values()) + docs, sum(r.types for r in many.values()) + (docs > 0), of, kept)
        clash = words.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
        floor = self._floor(words, head)
        own = words.where(F.col("n") >= floor).unionByName(words.join(clash, "id", "left_semi").where(F.col("n") < floor))
        frequent = own.select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # bounded by head, but for clashes
        self.table, self.frequent = words, frequent.select(["word"]).append_column("own", pa.array(range(FIRST, FIRST + len(frequent)), pa.int64()))
        self.ids = MARKS | {w: FIRST + k for k, w in enumerate(frequent.column("word").to_pylist())}
        self.counts = np.concatenate(([docs, docs], frequent.column("n").to_numpy())).astype(np.int64)
        pairs = table.where("pair >= 0").select("pair", "n").toArrow()  # bounded by hot
        times = dict(zip(pairs.column("pair").to_pylist(), pairs.column("n").to_pylist()))
        self.hot = {(self.ids[h], self.ids[w]): times[k] for k, (h, w) in enumerate(proposed)
                    if times.get(k, 0) > LARGE + 1 and h in self.ids and w in self.ids}

    @staticmethod
    def _floor(words: DataFrame, head: int) -> int:
        steps = words.where("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"))
        total, floor = 0, 1 << 62
        for r in steps.orderBy(F.desc("s")).collect():  # at most 8 x 63 rows
            total += r.many
            if total > head:
                break
            floor = r.least
        return floor

    def buckets(self) -> int:
        return max(1, -(-self.totals.tokens // BUCKET))


# -- transitions, dealt to buckets -------------------------------------------------

_DOC = pa.struct([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("base", pa.float64()), ("seen", pa.float64()), ("past", pa.float64())])
_DOC_SQL = "array<struct<doc_id:bigint,train:boolean,n_tokens:bigint,n_known:bigint,base:double,seen:double,past:double>>"
_SENT = ("bucket int, chunk long, train boolean, h array<int>, w array<int>, row array<smallint>, "
         f"lh array<bigint>, lw array<bigint>, lrow array<smallint>, docs {_DOC_SQL}")


def _sent(texts: DataFrame, words: Words) -> DataFrame:
    """Per chunk: its documents with what is known on the spot, and its other
    transitions by bucket."""
    known, counts, n_buckets = words.ids, words.counts, words.buckets()
    width = len(counts)
    hot_keys = np.array(sorted(h * width + w for h, w in words.hot), np.int64)
    opens, closes = np.zeros(width, bool), np.zeros(width, bool)  # words that begin or end one
    opens[hot_keys // width], closes[hot_keys % width] = True, True
    hot_logs = np.log10(np.array([words.hot[k // width, k % width] for k in hot_keys.tolist()], float) - LOSS)
    base, past = words.totals.log_base(counts), np.log10(np.maximum(counts, 1))
    past_start = float(np.log10(max(1, words.totals.docs)))
    split = 1 + counts // (BUCKET // 8)  # a history's share of buckets

    def chunk_rows(chunk: int, docs: list, sizes_: list[int], line: list[int]) -> pa.RecordBatch:
        sizes, flat, n_docs = np.array(sizes_), np.array(line, np.int64), len(docs)
        row = np.repeat(np.arange(n_docs), sizes)
        step = flat[1:] != START  # no transition into the next document
        h, w, at = flat[:-1][step], flat[1:][step], row[1:][step]
        train = np.array([d[1] for d in docs])
        frequent = (w >= 0) & (w < width)
        fw = np.where(frequent, w, 0)
        n_known = np.bincount(at, frequent & (counts[fw] > 0), n_docs)
        base_sum = np.bincount(at, np.where(frequent, base[fw], 0), n_docs)
        past_sum = np.bincount(at, np.where(frequent & (w != END), past[fw], 0), n_docs) + past_start
        seen = np.zeros(n_docs)
        fh = (h >= 0) & (h < width)
        rest = np.ones(len(h), bool)
        if len(hot_keys):
            likely = np.flatnonzero(fh & frequent & opens[np.where(fh, h, 0)] & closes[fw])
            code = h[likely] * width + fw[likely]
            k = np.minimum(np.searchsorted(hot_keys, code), len(hot_keys) - 1)
            is_hot = hot_keys[k] == code
            seen += np.bincount(at[likely[is_hot]], hot_logs[k[is_hot]], n_docs)
            rest[likely[is_hot]] = False
        h, w, at, frequent, fh = h[rest], w[rest], at[rest], frequent[rest], fh[rest]
        mixed = _mix(w)
        by_history = _mix(h)
        shares = np.where(fh, split[np.where(fh, h, 0)], 1)
        large = np.flatnonzero(shares > 1)
        by_history[large] += mixed[large] % shares[large].astype(np.uint64)
        key = np.where(frequent, _mix(by_history), mixed)
        bucket = (key % np.uint64(n_buckets)).astype(np.int64)
        group = (bucket * 2 + train[at]) * 2 + ~(frequent & fh)
        order = np.argsort((group << 32) | (h & 0xFFFFFFFF))
        group, h, w, at = group[order], h[order], w[order], at[order].astype(np.int16)
        packs, starts = np.unique(group >> 1, return_index=True)
        stops = np.append(starts[1:], len(group))
        wide = (group & 1) == 1
        narrow_stops = np.cumsum(np.add.reduceat((~wide).astype(np.int64), starts)) if len(starts) else np.empty(0, np.int64)
        wide_stops = stops - narrow_stops
        n = len(packs) + 1  # and the row with the documents
        record = [{"doc_id": d[0], "train": d[1], "n_tokens": int(s) - 1, "n_known": int(k), "base": float(b), "seen": float(x), "past": float(p)}
                  for d, s, k, b, x, p in zip(docs, sizes, n_known, base_sum, seen, past_sum)]

        def lists(values, stops, kind):
            return _lists(values, np.append(stops, stops[-1] if len(stops) else 0), kind)

        return pa.RecordBatch.from_arrays([
            pa.array(np.append(packs >> 1, chunk % n_buckets), pa.int32()), pa.array([chunk] * n, pa.int64()),
            pa.array(np.append((packs & 1) == 1, False), pa.bool_()),
            lists(h[~wide], narrow_stops, pa.int32()), lists(w[~wide], narrow_stops, pa.int32()), lists(at[~wide], narrow_stops, pa.int16()),
            lists(h[wide], wide_stops, pa.int64()), lists(w[wide], wide_stops, pa.int64()), lists(at[wide], wide_stops, pa.int16()),
            pa.array([None] * (n - 1) + [record], pa.list_(_DOC))],
            ["bucket", "chunk", "train", "h", "w", "row", "lh", "lw", "lrow", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24  # the task's rows come in a fixed order
        ids, docs, sizes, line = Ids(known), [], [], []
        for b in batches:
            names, flags, texts_ = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).cast(pa.binary())
            for i, (name, flag) in enumerate(zip(names, flags)):
                words_ = words_of(texts_[i].as_py())
                line.append(START)
                line += map(ids.__getitem__, words_)
                line.append(END)
                docs.append((name, flag))
                sizes.append(len(words_) + 2)
                if len(docs) >= CHUNK_DOCS or len(line) >= CHUNK_TOKENS:
                    yield chunk_rows(chunk, docs, sizes, line)
                    chunk, ids, docs, sizes, line = chunk + 1, Ids(known), [], [], []
        if docs:
            yield chunk_rows(chunk, docs, sizes, line)

    return texts.select("doc_id", "text", "train").transform(map_arrow, run, _SENT)


# -- buckets: counts, sent back -------------------------------------------------------

_HISTORY = [f"m{r}" for r in range(1, LARGE + 1)] + ["large", "mass"]
_BACK = ("kind string, chunk long, docs " + _DOC_SQL + ", row array<smallint>, c array<bigint>, wrow array<smallint>, wc array<bigint>, "
         "urow array<smallint>, uh array<int>, uc array<bigint>, trow array<smallint>, th array<bigint>, "
         "h array<bigint>, sums array<double>, types array<bigint>, w array<bigint>, n array<bigint>")


def _counted(sent: DataFrame, words: Words) -> DataFrame:
    """Rows of kind ``chunk`` (documents; counts of transitions ``c`` by ``row``; of
    rare words ``wc`` by ``wrow``; unseen transitions: word counts ``uc`` by ``urow``
    with the frequent history ``uh``, else -1; rare histories ``th`` by ``trow``), of
    kind ``bigram`` (``h``, ``w``, ``n``: the counts) and of kind ``model`` (histories
    ``h`` with their ``sums``; types by count)."""
    counts, width, totals = words.counts, len(words.counts), words.totals

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in (x.split()[0] for x in _BACK.replace(_DOC_SQL, "x").split(", "))}

        def put(**row) -> None:
            for n, v in out.items():
                v.append(row.get(n))

        chunks, flags = table.column("chunk").to_pylist(), table.column("train").to_pylist()
        docs = table.column("docs")
        for i in range(table.num_rows):
            if docs[i].is_valid:
                put(kind="chunk", chunk=chunks[i], docs=docs[i].as_py())
        tables = [tuple(table.column(n).combine_chunks() for n in names) for names in (("h", "w", "row"), ("lh", "lw", "lrow"))]
        found = np.zeros(LARGE + 1, np.int64)
        for part in tables:  # pairs of frequent words, and others: no bigram is in both
            h, w, row = (x.flatten().to_numpy() for x in part)
            h, w = h.astype(np.int64), w.astype(np.int64)
            if not len(h):
                continue
            sizes = np.diff(part[0].offsets.to_numpy())
            train = np.repeat(np.array(flags, bool), sizes)
            wide = part is tables[1]
            order = np.lexsort((w, h)) if wide else np.argsort((h << 32) | w)
            hs, ws = h[order], w[order]
            starts = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))))
            times = np.add.reduceat(train[order].astype(np.int64), starts)
            c = np.empty(len(h), np.int64)
            c[order] = np.repeat(times, np.diff(np.append(starts, len(h))))
            rare, rh = (w < 0) | (w >= width), (h < 0) | (h >= width)
            wc = counts[np.where(rare, 0, w)]
            if wide and rare.any():  # all occurrences of a rare word are here
                _, inverse = np.unique(w[rare], return_inverse=True)
                wc[rare] = np.bincount(inverse, train[rare]).astype(np.int64)[inverse]
            # each history's sums over its types here
            first, on = order[starts], times > 0
            th, tc, tw = h[first][on], times[on], wc[first][on]
            found += np.bincount(np.minimum(tc, LARGE + 2), minlength=LARGE + 3)[1:LARGE + 2]
            for k in range(0, len(th), PART):
                put(kind="bigram", h=th[k:k + PART], w=w[first][on][k:k + PART], n=tc[k:k + PART])
            if len(th):
                at = np.flatnonzero(np.concatenate(([True], th[1:] != th[:-1])))
                parts = [tc == r for r in range(1, LARGE + 1)] + [tc > LARGE, 10.0 ** totals.log_word(tw)]
                sums = np.stack([np.add.reduceat(p.astype(float), at) for p in parts], axis=1)
                for k in range(0, len(at), PART):
                    put(kind="model", h=th[at[k:k + PART]], sums=sums[k:k + PART].ravel())
            # each chunk's own occurrences: a pack's stand together
            stops = np.cumsum(sizes)
            for i in np.flatnonzero(sizes).tolist():
                a, b = int(stops[i] - sizes[i]), int(stops[i])
                o = a + np.argsort(row[a:b], kind="stable")
                seen, word, lost = o[c[o] > 0], o[rare[o]], o[c[o] == 0]
                tail = lost[rh[lost]]
                put(kind="chunk", chunk=chunks[i], row=row[seen], c=c[seen], wrow=row[word], wc=wc[word],
                    urow=row[lost], uh=np.where(rh[lost], -1, h[lost]), uc=wc[lost], trow=row[tail], th=h[tail])
        put(kind="model", types=found)
        return _table(out)

    types = {"kind": pa.string(), "chunk": pa.int64(), "docs": pa.list_(_DOC), "c": pa.list_(pa.int64()), "wc": pa.list_(pa.int64()),
             "uh": pa.list_(pa.int32()), "uc": pa.list_(pa.int64()), "th": pa.list_(pa.int64()), "h": pa.list_(pa.int64()),
             "sums": pa.list_(pa.float64()), "types": pa.list_(pa.int64()), "w": pa.list_(pa.int64()), "n": pa.list_(pa.int64())}

    def _table(out: dict[str, list]) -> pa.Table:
        return pa.table({n: pa.array(v, types.get(n, pa.list_(pa.int16()))) for n, v in out.items()})

    return sent.groupBy("bucket").applyInArrow(run, _BACK)


# -- weights and scores ----------------------------------------------------------------

def _histories(counted: DataFrame, words: Words, stars: np.ndarray) -> DataFrame:
    """(h, back): log10 of alpha(h) c(h) of every history, over all buckets."""
    n = len(_HISTORY)
    rows = counted.where("kind = 'model' AND h IS NOT NULL").select(F.posexplode("h").alias("i", "h"), "sums").select(
        "h", *[F.get("sums", F.col("i") * n + k).alias(x) for k, x in enumerate(_HISTORY)])
    hot = Counter()
    for h, w in words.hot:
        hot[h, "large"] += 1
        hot[h, "mass"] += float(10 ** words.totals.log_word(words.counts[[w]])[0])
    spark = counted.sparkSession
    if words.hot:
        extra = [(h, *(float(hot.get((h, x), 0)) for x in _HISTORY)) for h in sorted({h for h, _ in words.hot})]
        rows = rows.unionByName(spark.createDataFrame(extra, "h long, " + ", ".join(f"{x} double" for x in _HISTORY)))
    total = rows.groupBy("h").agg(*[F.sum(x).alias(x) for x in _HISTORY])
    rest = F.lit(LOSS) * F.col("large")
    for r in range(1, LARGE + 1):
        rest = rest + F.lit(float(r - stars[r])) * F.col(f"m{r}")
    # alpha c(h) = discounted mass in counts / unigram mass of the words not seen; the
    # unknown word is never seen, so that mass is positive
    return total.select("h", F.log10(rest / F.greatest(1 - F.col("mass"), F.lit(float(words.totals.unknown)))).alias("back"))


@dataclass(frozen=True)
class Model:
    """What was learned, as tables that stay in the shared folder."""

    #: (word, id, n): words of all texts and their training occurrences.
    words: DataFrame
    #: (h, w, n): counts of the seen bigrams, by the ids of their words (0: start,
    #: 1: end). P(w|h) = n* / count of h.
    bigrams: DataFrame
    #: (h, back): log10 of alpha(h) times the count of h.
    weights: DataFrame
    totals: Totals
    #: n* of small bigram counts; larger ones lose LOSS.
    stars: np.ndarray


def score(docs: DataFrame, head: int = HEAD, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text), a row per row: doc_id, train, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability of the text)."""
    return learn_and_score(docs, head, hot)[0]


def learn_and_score(docs: DataFrame, head: int = HEAD, hot: int = HOT) -> tuple[DataFrame, Model]:
    """The scores, and the model."""
    texts = _texts(docs)
    words = Words(texts, head, hot)
    path = shared_path(docs.sparkSession, "katz-counts")
    counted = _counted(_sent(texts, words), words)
    counted.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    counted = docs.sparkSession.read.schema(counted.schema).parquet(path)
    of = Counter()
    for r in counted.where("kind = 'model' AND types IS NOT NULL").select(F.posexplode("types").alias("r", "n")).groupBy("r").agg(
            F.sum("n").alias("n")).collect():  # LARGE + 1 rows
        of[r.r + 1] = r.n
    stars = discounted(of)
    backs = shared_table(_histories(counted, words, stars), "katz-weights")
    width = len(words.counts)
    known = np.zeros(width)
    own = backs.where((F.col("h") >= 0) & (F.col("h") < width)).toArrow()  # bounded by head
    known[own.column("h").to_numpy()] = own.column("back").to_numpy()
    chunks = counted.where("kind = 'chunk'")
    lost = chunks.where(F.size("th") > 0).select("chunk", F.explode(F.arrays_zip("trow", "th")).alias("x")).select(
        "chunk", F.col("x.trow").alias("at"), F.col("x.th").alias("h"))
    found = lost.join(backs.where((F.col("h") < 0) | (F.col("h") >= width)), "h").groupBy("chunk", "at").agg(F.sum("back").alias("back"))
    parts = chunks.select("chunk", "docs", "row", "c", "wrow", "wc", "urow", "uh", "uc", F.lit(None).cast("smallint").alias("at"), F.lit(None).cast("double").alias("back"))
    none = {x: F.lit(None).cast(parts.schema[x].dataType).alias(x) for x in ("docs", "row", "c", "wrow", "wc", "urow", "uh", "uc")}
    parts = parts.unionByName(found.select("chunk", *none.values(), "at", "back"))
    totals = words.totals

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs_ = [d for x in table.column("docs").to_pylist() if x for d in x]
        n = len(docs_)

        def flat(name: str) -> np.ndarray:
            column = table.column(name).combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        def by_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.bincount(rows, values, n) if len(rows) else np.zeros(n)

        total = np.array([d["seen"] - d["past"] for d in docs_])
        total += by_row(flat("row"), np.log10(lowered(flat("c"), stars)))
        rows, wc = flat("wrow"), flat("wc")
        total -= by_row(rows, np.log10(np.maximum(wc, 1)))
        base = np.array([d["base"] for d in docs_]) + by_row(rows, totals.log_base(wc))
        n_known = np.array([d["n_known"] for d in docs_]) + by_row(rows, wc > 0).astype(np.int64)
        rows, uh, uc = flat("urow"), flat("uh"), flat("uc")
        total += by_row(rows, np.where(uh >= 0, known[np.maximum(uh, 0)], 0) + totals.log_word(uc))
        at = table.column("at").drop_null().to_numpy().astype(np.int64)
        total += by_row(at, table.column("back").drop_null().to_numpy())
        return pa.table({
            "doc_id": pa.array([d["doc_id"] for d in docs_], pa.int64()), "train": pa.array([d["train"] for d in docs_], pa.bool_()),
            "n_tokens": pa.array([d["n_tokens"] for d in docs_], pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([totals.tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    scored = parts.groupBy("chunk").applyInArrow(
        run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    spark = docs.sparkSession
    pairs = counted.where("kind = 'bigram'").select(F.explode(F.arrays_zip("h", "w", "n")).alias("x")).select("x.*")
    sure = [(h, w, n) for (h, w), n in words.hot.items()]  # bounded by hot
    if sure:
        pairs = pairs.unionByName(spark.createDataFrame(sure, "h long, w long, n long"))
    own = spark.createDataFrame(words.frequent, "word binary, own long")
    named = words.table.join(own, "word", "left").select("word", F.coalesce("own", "id").alias("id"), "n")
    return scored, Model(named, pairs, backs, totals, stars)
