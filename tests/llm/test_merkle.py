import hashlib
import zlib
from itertools import groupby

import pytest

from trellis.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, grp int, place int, level int"


def h(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def lowered(row):
    text = row[4]
    return (*row[:4], None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def fold(tree, i, own):
    proof = ""
    for level in tree[:-1]:
        run, at = level[i // 8 * 8:i // 8 * 8 + 8], i % 8
        proof += "".join(run[:at] + run[at + 1:])
        own = h("".join(run[:at]) + own + "".join(run[at + 1:]))
        i //= 8
    return own, proof


def direct(rows):
    """Proof by proof, with all levels in memory."""
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    rows = sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key)]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (rows, tree) in enumerate(zip(groups, trees)):
        for i, r in enumerate(rows):
            own = leaf(lowered(r)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else tree[0][i]
            own, low = fold(tree, i, own)
            own, high = fold(top, g, own)
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], low + high, own, own == top[-1][0]))
    return sorted(out, key=repr)


def run(docs):
    built = M.manifest(docs)
    return built, sorted((tuple(r) for r in M.proofs(built).collect()), key=repr)


TEXT = "Some Text With Capitals"
CASES = {
    "nulls": [(None, None, None, None, None), (1, None, "en", 3, "Abc"), (2, "s", None, 0, ""), (None, "s", "en", 1, "Q"), (6, "a", "", 5, TEXT)],
    "one group": [(i, "s", "en", i, TEXT + str(i)) for i in range(70)],
    "a lone leaf": [(3, "s", "en", 4, TEXT)],
    "lone leaves of many groups": [(i, "s", f"l{i}", 4, TEXT) for i in range(20)],
    "repeated rows": [(5, "s", "en", 4, TEXT)] * 30 + [(5, "t", "en", 4, TEXT)] * 3 + [(i, "s", "dé", 4, TEXT) for i in range(9)],
    "exact powers": [(i, None, "a", None, None) for i in range(64)] + [(i, None, "b", None, "T") for i in range(8)] + [(i, None, "c", None, "T") for i in range(9)],
    "long": [(0, "s", "en", 1, "Long " * 400_000), (1, "ünï\n:-", "zh", 1, "汉字 A"), (9, "s", "en", 1, "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_levels_in_memory(spark, name):
    rows = CASES[name]
    _, got = run(spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA))
    assert got == direct(rows)


def test_given_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    built, got = run(documents)
    assert got == direct(rows)
    # tampering shows exactly where a capital went
    tampered = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and lowered(r) != r}
    assert {r[0] for r in got if not r[6]} == tampered and 0 < len(tampered) < len(rows)
    # node rows are linked: each parent's digest is that of its children in order
    nodes = built.nodes.collect()
    assert sum(n.p_grp is None for n in nodes) == 1
    kids = {}
    for n in nodes:
        kids.setdefault((n.p_grp, n.p_level, n.p_idx), []).append(n)
    for n in nodes:
        own = sorted(kids.get((n.grp, n.level, n.idx), ()), key=lambda k: k.grp.encode() if n.grp == M.TOP and n.level == 1 else k.idx)
        assert not own or h("".join(k.digest.hex() for k in own)) == n.digest.hex()


def test_recursion_has_no_row_limit(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    try:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "3")
        rows = CASES["one group"]
        assert run(spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA))[1] == direct(rows)
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "3"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_empty(spark):
    built, got = run(spark.createDataFrame([], SCHEMA))
    assert got == [] and built.root is None
