"""SimHash fingerprints, the trie self-join and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trellis.llm import simhash


def slow_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in " ".join(words)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) <= width else [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, max_bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


TEXTS = ["A b  C d", "a\tb\nc d", "a b", "a b c", "", None, " \n ", "é À b c d e", "x " * 50, "x x x", "a\x1cb c d", "Ünï Ä ß a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.text_fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert got % (1 << 64) == xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_trie_pairs(max_bits):
    rng = random.Random(max_bits)
    near = [rng.getrandbits(64) for _ in range(20)]
    values = {x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for x in near for _ in range(15)}
    a = np.array(sorted(values), np.uint64)
    got = {(int(i), int(j)) for x, y in simhash.trie_pairs(a, None, 0, max_bits, 63) for i, j in zip(x, y)}
    want = {(i, j) for i, j in combinations(range(len(a)), 2) if (int(a[i]) ^ int(a[j])).bit_count() <= max_bits}
    assert got == want


@pytest.mark.parametrize("node_size", [30_000, 3])
def test_components_equal_brute_force(spark, monkeypatch, node_size):
    monkeypatch.setattr(simhash, "NODE_SIZE", node_size)
    monkeypatch.setattr(simhash, "DEPTHS", (2, 6, 9))
    rng = random.Random(7)
    fps, x = [], 5
    for _ in range(40):  # a long chain, one bit a step
        x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(40)] + [0, 0, 3, 7] + fps[:5]
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    ids[3] = None
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    marked = spark.createDataFrame(list(zip(ids, signed, range(len(fps)))), "doc_id long, fp long, n int")
    rows = simhash.classes(marked, 2).collect()
    want = slow_components(ids, fps)
    assert len(rows) == len(fps) and all(r.component_id == want[r.n] for r in rows)


def test_query_and_one_of_each(spark):
    rows = [(5, "one two three four five"), (2, "ONE two three\tfour five"), (9, "something else is here now"), (None, None), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, i, "x", 1) for i, t in rows], "doc_id long, text string, fp long, row string, at int")
    got = sorted((r.component_id, r.doc_id if r.doc_id is not None else -1, r.fingerprint) for r in simhash.near_duplicates(docs).collect())
    zero = "0" * 16
    assert [g[:2] for g in got] == [(2, 2), (2, 5), (4, -1), (4, -1), (4, 4), (4, 4), (9, 9)]
    assert all(g[2] == zero for g in got if g[0] == 4) and all(len(g[2]) == 16 for g in got)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_documents(spark, documents):
    docs = documents.where("doc_id < 300")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    fps = [simhash.text_fingerprint(texts[i].encode()) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i].component_id for i in ids] == slow_components(ids, fps)


def test_walk_holds_few_node_pairs_at_once():
    """A full node's walk stays in bounded memory (178 MB with a frontier of 2^20)."""
    import tracemalloc

    import numpy as np

    from trellis.llm import simhash

    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 48_000).astype(np.uint64) * np.uint64(2))
    tracemalloc.start()
    try:
        sum(len(i) for i, _ in simhash.trie_pairs(a, None, 0, 2, 63))
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()
