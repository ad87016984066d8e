"""SimHash near-duplicates: fingerprints, then a binary-trie self-join.

A fingerprint summarises the word shingles of a text. Two texts are linked when
their fingerprints differ in at most ``max_bits`` bits; linked texts form
components. The self-join walks a binary trie over the *distinct* fingerprints:
a pair of nodes is opened together, each step adds one to the error of the two
children pairs that take different bits, and a pair whose error exceeds the
budget is dropped with everything below it.

On Spark the top ``depth`` levels of that walk are an equi-join key: a trie node
at that depth is a prefix, and every fingerprint is dealt to the pairs
(own prefix, prefix within the budget). ``depth`` is taken from the counted size
of the fullest node, so that a group stays small however many fingerprints there
are. Below it, each group walks its two subtries in numpy over sorted arrays (a
sorted array is a binary trie: a node is a slice), and returns a spanning forest
of its links, never all pairs.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; texts shorter than a shingle use their whole word sequence;
repeated rows each get a row; a null ``doc_id`` never is a component's id unless
all of the component's ids are null; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import join_checked, map_arrow, shared_table
from trellis.session import ship_package

#: Most distinct fingerprints below one trie node before the join starts deeper.
NODE_SIZE = 30_000
DEPTHS = (6, 10, 14, 18, 22)
#: Node pairs that a group's walk holds at once; beyond, it goes on in halves.
FRONTIER = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def text_fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    from xxhash import xxh64_digest

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        digests = xxh64_digest(b" ".join(words), 42)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        stops = (ends[width - 1:] - 1).tolist()
        digests = b"".join([xxh64_digest(line[a:b], 42) for a, b in zip(starts, stops)])
    n = len(digests) // 8
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)  # big-endian: bit 63 first
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, keep: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, fp long: the fingerprint's bits), and the
    long column ``keep`` if one is named."""
    more = [keep] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((text_fingerprint(texts[i].as_py(), width) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).transform(
        map_arrow, run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the one-child of each node (slice) begins."""
    key = ((values[lo] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)
    return np.minimum(np.searchsorted(values, key), hi)


def trie_pairs(a: np.ndarray, b: np.ndarray | None, errors: int, max_bits: int, bit: int) -> Iterator[tuple]:
    """Walk the subtries over the sorted distinct values ``a`` and ``b`` (None: a
    self-join of ``a``) from ``bit`` down; yields index arrays (i, j) of links."""
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    one = np.zeros(1, np.int64)
    stack = [(bit, one, one + len(a), one, one + len(b), one + errors)]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():  # a path without branches: the rest of the bits at once
            i, j = alo[leaf], blo[leaf]
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or bit < 0:
            continue
        am, bm = _children(a, alo, ahi, bit), _children(b, blo, bhi, bit)
        same = own & (alo == blo) & (ahi == bhi)
        parts = []
        for x, y, step in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            part = ((alo, am), (am, ahi))[x] + ((blo, bm), (bm, bhi))[y] + (err + step,)
            keep = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= max_bits)
            if (x, y) == (1, 0):
                keep &= ~same  # a node with itself: (0, 1) covers (1, 0)
            parts.append([z[keep] for z in part])
        nxt = [np.concatenate(z) for z in zip(*parts)]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))


def _forest(n: int, links: Iterator[tuple]) -> np.ndarray:
    """Smallest index linked with each of n, by links met one chunk at a time."""
    root = np.arange(n)
    for i, j in links:
        while True:  # hook the larger root below the smaller, then shorten paths
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if not open_.any():
                break
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``fps`` (fp long) to (u, v): links whose transitive closure is
    that of all pairs within ``max_bits``."""
    ship_package(fps.sparkSession)
    depth = DEPTHS[-1]
    for d in DEPTHS:  # one small aggregate each; the first is nearly always enough
        most = fps.groupBy(F.shiftrightunsigned("fp", 64 - d)).count().agg(F.max("count")).first()[0]
        if (most or 0) <= NODE_SIZE:
            depth = d
            break
    flips = [0]
    for k in range(1, min(max_bits, depth) + 1):
        flips += [m for m in _masks(depth, k)]
    node = F.shiftrightunsigned("fp", 64 - depth)
    dealt = (fps.select("fp", node.alias("node"), F.explode(F.array(*map(F.lit, flips))).alias("flip"))
             .select("fp", F.least("node", F.col("node").bitwiseXOR(F.col("flip"))).alias("p"),
                     F.greatest("node", F.col("node").bitwiseXOR(F.col("flip"))).alias("q")))
    shift, first = np.uint64(64 - depth), 63 - depth

    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        if p == q:
            root = _forest(len(values), trie_pairs(values, None, 0, max_bits, first))
        else:
            cut = int(np.searchsorted(values, np.uint64(q) << shift))
            pairs = ((i, j + cut) for i, j in trie_pairs(values[:cut], values[cut:], (p ^ q).bit_count(), max_bits, first))
            root = _forest(len(values), pairs)
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"u": values[moved].view(np.int64), "v": values[root[moved]].view(np.int64)})

    return dealt.groupBy("p", "q").applyInArrow(walk, "u long, v long")


def _masks(width: int, ones: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << k for k in c) for c in combinations(range(width), ones)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) by alternating large and small stars:
    (node, root) for every node that has a link. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of a component."""
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = shared_table(tidy(edges), "edges")
    before, mark = None, state(now)
    while mark[0] and mark != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = shared_table(tidy(small), "edges")
        before, mark = mark, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` (doc_id, text) to one row per document: doc_id, fingerprint,
    component_id (the smallest doc_id reachable over links, its own included)."""
    marked = shared_table(fingerprints(docs, width), "fingerprints")
    return classes(marked, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """Adds component_id and root (the component's least fingerprint) to a written
    table of (doc_id, fp, ...)."""
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("own_id"))
    fps = shared_table(own, "distinct-fingerprints")
    roots = components(links(fps.select("fp"), max_bits))
    # only fingerprints with a link need another's id
    group = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "own_id", F.coalesce("root", "fp").alias("root"))
    ids = group.groupBy("root").agg(F.min("own_id").alias("component_id"))
    named = shared_table(group.join(ids, "root").select("fp", "component_id", "root"), "classes")
    return marked.join(named, "fp", "left")


def one_of_each(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents, columns as they are, but of each component only the one with
    the smallest doc_id (null last; of equal ids one row)."""
    rows = shared_table(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row")), "numbered")
    texts = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "at")
    marked = shared_table(fingerprints(texts, width, keep="at"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at"))
    kept = classes(marked, max_bits).groupBy("root").agg(first.alias("first")).select("first.at")
    gone = shared_table(marked.select("at").join(kept, "at", "left_anti"), "near-duplicates")
    return join_checked(rows, gone, "at", "left_anti").select("row.*")
