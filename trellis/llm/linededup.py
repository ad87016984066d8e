"""Line dedup by pairwise alignment.

Overlapping documents are found through rare runs of lines. From every line of a
document, the fewest lines on that have ``MIN_WORDS`` words are hashed; such a run is
rare if at most half of all documents hold it (or at most ``FEW``, which tell nothing):
what more hold is a template of the corpus, no copy. Each later holder of a rare run
is paired with the run's first document (smallest doc_id). So the pairs grow with the
lines, however many documents share a run, and a document meets for every run some
earlier document that holds it whole: any passage of ``MIN_WORDS`` words or more that
an earlier document has, in full lines, begins with a run that leads to one.

A pair is aligned once, over all lines of both documents, by patience diff: equal
lines at the ends are matched, then lines that occur once on either side are anchors,
the longest increasing run of anchors is kept, and the gaps between them are aligned in
the same way (where no line is unique, the n-th occurrences are matched). Lines that
follow each other on both sides of the alignment make a block; what an alignment
leaves over may be moved, so it is matched to runs of the earlier document as it
stands. A block goes from the later document if it holds a rare run. Single lines that
many documents happen to have stay, unless they lie in such a block or are as long as
a run by themselves.

Defined results: lines are compared without surrounding white space, blank lines
never match and stay; null and empty texts are unchanged; rows with equal ids and
equal texts are one document and each row gets the same result; a null doc_id comes
after all others; equal ids with different texts are ordered by a hash of the text; a
very long text is as many lines as it has, its pairs are aligned one at a time; an
empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import map_arrow, shared_table, with_row

#: Words of a run of lines that tells a copy.
MIN_WORDS = 20
#: A run is rare in at most this share of the documents, or in at most FEW.
RARE_SHARE, FEW = 0.5, 100
#: Lines that a task hands on at once.
GATHER = 100_000
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def line_hashes(text: bytes | None) -> tuple[list[int], list[int]]:
    """Hash and number of words of the lines that hold a word."""
    from xxhash import xxh64_intdigest

    hashes, words = [], []
    for line in (text or b"").split(b"\n"):
        line = line.strip()
        if line:
            hashes.append(xxh64_intdigest(line) - (1 << 63))
            words.append(len(line.split()))
    return hashes, words


def runs(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of the fewest lines from each line on
    that have ``min_words`` words, where there are as many."""
    total = np.concatenate(([0], np.cumsum(words)))
    start = np.arange(len(hashes))
    end = np.searchsorted(total, total[:-1] + min_words)
    start, end = start[end <= len(hashes)], end[end <= len(hashes)]
    n = len(hashes)
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n), x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.uint64) * up[:n])))
    h = ((sums[end] - sums[start]) * down[start]) ^ ((end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return start, end, (h ^ (h >> np.uint64(32))).view(np.int64)


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k:k + 1] = [v]
        at[k:k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched lines (place in ``a``, place in ``b``) of a patience diff, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {a[i]: i for i in range(alo, ahi) if na[a[i]] == 1}
        anchors = [(place[b[j]], j) for j in range(blo, bhi) if nb[b[j]] == 1 and b[j] in place]
        if anchors:
            anchors = [anchors[i] for i in longest_increasing([x for x, _ in anchors])]
            edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
            out += anchors
        else:  # every common line repeats: its n-th occurrences belong together
            nth: dict[int, list[int]] = {}
            for i in range(alo, ahi):
                nth.setdefault(a[i], []).append(i)
            seen: Counter[int] = Counter()
            both = []
            for j in range(blo, bhi):
                if seen[b[j]] < len(nth.get(b[j], ())):
                    both.append((nth[b[j]][seen[b[j]]], j))
                    seen[b[j]] += 1
            out += [both[i] for i in longest_increasing([x for x, _ in both])]
    return sorted(out)


def blocks(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """(first line in ``b``, line after the last) of the common blocks of two
    documents: those of the alignment, and moved ones in what it leaves over."""
    matched = patience(a, b)
    out, begin = [], 0
    for i in range(1, len(matched) + 1):
        if i == len(matched) or (matched[i][0] - matched[i - 1][0], matched[i][1] - matched[i - 1][1]) != (1, 1):
            out.append((matched[begin][1], matched[i - 1][1] + 1))
            begin = i
    left = sorted(set(range(len(b))) - {y for _, y in matched})
    first: dict[int, int] = {}
    for i in range(len(a) - 1, -1, -1):
        first[a[i]] = i
    at, stop = -1, -1  # the earlier document's line that would go on the run, and the later's
    for y in left:
        if y == stop and at < len(a) and a[at] == b[y]:
            out[-1] = (out[-1][0], y + 1)
        elif b[y] in first:
            at = first[b[y]]
            out.append((y, y + 1))
        else:
            continue
        at, stop = at + 1, y + 1
    return out


def _identity(id_: Column, text: Column) -> list[Column]:
    return [F.coalesce(id_.cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.lit(7), text).alias("body")]


def _line_table(docs: DataFrame) -> DataFrame:
    """(id, body, hashes, words: of the lines with a word), a row per document (rows that
    repeat are one), written: so AQE can split a document that very many are paired with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes, words, begin = b.column(2).cast(pa.binary()), [], [], 0
            size = 0
            for i in range(b.num_rows):
                h, w = line_hashes(texts[i].as_py())
                hashes.append(h)
                words.append(w)
                size += len(h)
                if size > GATHER or i + 1 == b.num_rows:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))],
                        ["id", "body", "hashes", "words"])
                    hashes, words, begin, size = [], [], i + 1, 0

    rows = docs.select(*_identity(F.col("doc_id"), F.col("text")), F.col("text").cast("string"))
    lines = rows.transform(map_arrow, run, "id long, body long, hashes array<long>, words array<int>")
    return shared_table(lines.dropDuplicates(["id", "body"]), "document-lines")


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, body, h, at: first lines): the distinct runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            keys: list[int] = []
            places: list[list[int]] = []
            for i in range(b.num_rows):
                start, _, h = runs(b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy(), min_words)
                own: dict[int, list[int]] = {}
                for k, y in zip(h.tolist(), start.tolist()):
                    own.setdefault(k, []).append(y)
                rows += [i] * len(own)
                keys += own.keys()
                places += own.values()
                if len(rows) > GATHER or i + 1 == b.num_rows:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                                                     ["id", "body", "h", "at"])
                    rows, keys, places = [], [], []

    return lines.transform(map_arrow, run, "id long, body long, h long, at array<int>")


def overlaps(lines: DataFrame, min_words: int, rare: int) -> DataFrame:
    """(a, b: the earlier document's id and body; id, body: the later one's; at: first
    lines of the rare runs in it for which they are paired)."""
    found = _runs(lines, min_words)
    holder = F.struct("id", "body")
    owners = found.groupBy("h").agg(F.min(holder).alias("own"), F.max(holder).alias("last"), F.count(F.lit(1)).alias("n"))
    owners = owners.where((F.col("own") != F.col("last")) & (F.col("n") <= rare)).select("h", "own")
    owners = shared_table(owners, "rare-runs")  # a table, so that AQE can split a run that very many hold
    pairs = found.join(owners, "h").where("own.id != id OR own.body != body")
    return pairs.groupBy(F.col("own.id").alias("a"), F.col("own.body").alias("b"), "id", "body").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))  # no more than the document's lines


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, rare_share: float = RARE_SHARE) -> DataFrame:
    """(id, body, ranks: numbers of the lines to delete) of documents that lose lines."""
    lines = _line_table(docs)
    pairs = shared_table(overlaps(lines, min_words, max(FEW, int(rare_share * lines.count()))), "line-pairs")
    sides = pairs.join(lines, ["id", "body"]).join(
        lines.select(F.col("id").alias("a"), F.col("body").alias("b"), F.col("hashes").alias("earlier")), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = []
            for i in range(batch.num_rows):
                at, b, words, a = (batch.column(k)[i].values.to_numpy() for k in range(2, 6))
                start, end, _ = runs(b, words, min_words)
                stops = dict(zip(start.tolist(), end.tolist()))
                rare = sorted((y, stops[y]) for y in at.tolist())
                firsts = [y for y, _ in rare]
                gone: list[int] = []
                for y, z in blocks(a.tolist(), b.tolist()):
                    k = bisect_left(firsts, y)  # the first rare run that begins in the block ends soonest
                    if k < len(rare) and rare[k][1] <= z:
                        gone += range(y, z)
                ranks.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranks, pa.list_(pa.int32()))], ["id", "body", "ranks"])

    cut = sides.select("id", "body", "at", "hashes", "words", "earlier").transform(
        map_arrow, run, "id long, body long, ranks array<int>").where(F.size("ranks") > 0)
    return cut.groupBy("id", "body").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranks")))).alias("ranks"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare_share: float = RARE_SHARE) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (row: all other columns, text: what is
    left, n_lines: lines with a word, n_deleted: of them deleted)."""
    cut = deletions(docs, min_words, rare_share)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), *_identity(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranks = b.column(1).cast(pa.binary()), b.column(2).to_pylist()
            out, total, gone = [], [], []
            for i, cut_ranks in enumerate(ranks):
                text = texts[i].as_py()
                lines = (text or b"").split(b"\n")
                worded = [n for n, x in enumerate(lines) if x.strip()]
                if cut_ranks:
                    drop = {worded[r] for r in cut_ranks}
                    text = b"\n".join(x for n, x in enumerate(lines) if n not in drop)
                out.append(text)
                total.append(len(worded))
                gone.append(len(cut_ranks or ()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                ["row", "text", "n_lines", "n_deleted"])

    joined = rows.join(cut, ["id", "body"], "left").select("row", "text", "ranks")
    return joined.transform(map_arrow, run, with_row(joined, "text string, n_lines long, n_deleted long"))


def deduped_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns; those that lose their every line go.
    ``n_chars``, where it exists, follows the new text."""
    found = dedup_lines(docs, min_words).where("n_lines = 0 OR n_deleted < n_lines")
    at = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
          if "n_chars" in docs.columns else None}
    return found.select(*[(at[c] if c in at else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
