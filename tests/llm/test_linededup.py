"""Line dedup: the alignment against brute force, whole results against all pairs of
documents and all places, and planted passages."""

import random
import time

import numpy as np

from trellis.llm import linededup as L


def worded(text):
    return [x.strip() for x in (text or "").split("\n") if x.strip()]


def test_longest_increasing():
    rng = random.Random(0)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randrange(10))]
        got = [v[i] for i in L.longest_increasing(v)]
        best = max((sum(1 for _ in c) for m in range(1 << len(v)) for c in [[v[i] for i in range(len(v)) if m >> i & 1]]
                    if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_patience_is_a_longest_alignment_of_unique_lines():
    rng = random.Random(1)
    for k in range(400):
        a, b = ([rng.randrange(14 if k % 2 else 6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[x] == b[y] for x, y in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # then it is a longest common subsequence
            table = np.zeros((len(a) + 1, len(b) + 1), int)
            for i in range(len(a)):
                for j in range(len(b)):
                    table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
            head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert len(got) >= min(head, 1) and len(got) <= table[-1, -1]
            if not head and not (a and b and a[-1] == b[-1]):
                assert len(got) == table[-1, -1]


def test_blocks():
    assert L.blocks([1, 2, 3, 4, 5], [9, 1, 2, 8, 4, 5]) == [(1, 3), (4, 6)]
    assert sorted(L.blocks([1, 2, 3, 4, 5, 6, 7], [5, 6, 7, 0, 1, 2, 3, 4])) == [(0, 3), (4, 8)]  # a moved block
    assert sorted(L.blocks([1, 2], [1, 2, 0, 1, 2])) == [(0, 2), (3, 5)]  # the block twice
    assert sorted(L.blocks([1, 2, 3], [2, 0, 1, 2, 3])) == [(0, 1), (2, 5)]  # a line of it on its own before
    assert L.blocks([1, 2], []) == L.blocks([], [1]) == L.blocks([1], [2]) == []


def test_runs_equal_a_direct_search():
    rng = random.Random(3)
    for _ in range(100):
        words = [rng.randrange(1, 9) for _ in range(rng.randrange(30))]
        lines = [rng.randrange(-5, 5) for _ in words]
        start, end, h = L.runs(np.array(lines, np.int64), np.array(words, np.int64), 12)
        want = {i: min((j for j in range(i + 1, len(words) + 1) if sum(words[i:j]) >= 12), default=None) for i in range(len(words))}
        assert dict(zip(start.tolist(), end.tolist())) == {i: j for i, j in want.items() if j}
        content = [tuple(lines[i:j]) for i, j in zip(start, end)]
        assert all((x == y) == (content[i] == content[j]) for i, x in enumerate(h) for j, y in enumerate(h))


def test_long_documents_stay_cheap():
    lines = list(range(4000))
    for a, b in ((lines, lines[::-1]), ([1] * 4000, [1] * 3999 + [2]), (lines, lines[2000:] + lines[:2000]), ([1, 2] * 2000, [2, 1] * 2000)):
        begun = time.perf_counter()
        L.blocks(a, b)
        assert time.perf_counter() - begun < 2


def held(docs, min_words):
    """Per document, (first, after last) of the fewest lines from each line on that have
    ``min_words`` words and stand in an earlier document, and the lines of all longest
    runs that do: by all pairs of documents and all places."""
    lines = {d: worded(t) for d, t in docs.items()}
    out = {}
    for d in docs:
        spans, most = set(), set()
        for a in (a for a in docs if a < d):
            for i in range(len(lines[a])):
                for j in range(len(lines[d])):
                    n = 0
                    while i + n < len(lines[a]) and j + n < len(lines[d]) and lines[a][i + n] == lines[d][j + n]:
                        n += 1
                    sizes = np.cumsum([len(x.split()) for x in lines[d][j:j + n]])
                    if n and sizes[-1] >= min_words:
                        spans.add((j, j + int(np.argmax(sizes >= min_words)) + 1))
                        most.update(range(j, j + n))
        out[d] = spans, most
    return out


def corpus(rng, n):
    """Documents with lines of their own, lines that very many have, and passages of
    others in pieces."""
    common = [f"a common line {k} of five words"[: 30] for k in range(4)]
    docs = {}
    for i in range(n):
        own = [f"own{i}x{k} " + " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(8))) for k in range(rng.randrange(4, 20))]
        if i > 3 and i % 3:
            other = worded(docs[rng.randrange(i)])
            at = rng.randrange(len(other))
            own[2:2] = other[at:at + rng.randrange(1, 12)]
        for x in common:
            if rng.random() < 0.6:
                own.insert(rng.randrange(len(own)), x)
        docs[i] = "\n".join(x if rng.random() < 0.8 else f"  {x}\t\n" for x in own)
    docs[n] = docs[n - 1]
    return docs, common


def test_equals_all_pairs_and_places(spark):
    docs, common = corpus(random.Random(2), 70)
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs.items()], "doc_id long, text string, id int, body int, h int").repartition(5)
    got = {r.doc_id: r for r in L.dedup_lines(frame).select("row.doc_id", "text", "n_lines", "n_deleted").collect()}
    assert len(got) == len(docs) and got[70].text.strip() == ""
    ranks = {r.id: set(r.ranks) for r in L.deletions(frame).collect()}
    want, stays, cut = held(docs, L.MIN_WORDS), 0, 0
    for d, t in docs.items():
        raw, gone = t.split("\n"), ranks.get(d, set())
        places = [n for n, x in enumerate(raw) if x.strip()]
        spans, most = want[d]
        drop = {places[k] for k in gone}
        assert got[d].text == "\n".join(x for n, x in enumerate(raw) if n not in drop)
        assert {y for a, b in spans for y in range(a, b)} <= gone <= most, d  # all rare runs, and nothing but common blocks
        assert (got[d].n_lines, got[d].n_deleted) == (len(places), len(gone))
        stays += sum(x in common for x in worded(got[d].text))
        cut += len(gone)
    assert cut > 100 and stays > 100  # not the result of matching lines: common lines of five words stay


def test_planted_passages_and_edges(spark):
    passage = "\n".join(" ".join(f"p{k}{i}" for i in range(20)) for k in range(3))
    rows = [(3, f"first words here are mine\n{passage}\nlast words", "a"), (9, passage, "b"), (12, f"{passage}\nmy own text stays as it is\n\nend", "c"),
            (20, "a clean document with a line of its own\n\n", "d"), (21, None, "e"), (22, "", "f"), (22, "", "f"), (None, passage, "g"),
            (30, "x " * 40_000, "h"), (31, "y\n" * 3000, "i"), (32, "y\n" * 3000, "i"), (9, passage, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {(r.doc_id, r.rest): r.text for r in L.dedup_lines(docs).selectExpr("row.doc_id", "row.row AS rest", "text").collect()}
    assert got[3, "a"] == rows[0][1] and got[9, "b"] == "" and got[None, "g"] == ""
    assert got[12, "c"] == "my own text stays as it is\n\nend"
    assert got[20, "d"] == rows[3][1] and got[21, "e"] is None and got[22, "f"] == "" and got[30, "h"] == rows[8][1]
    assert got[31, "i"] == rows[9][1] and got[32, "i"] == ""
    assert L.dedup_lines(docs).count() == len(rows)
    kept = L.deduped_documents(docs.withColumn("n_chars", L.F.length("text").cast("long")))
    assert kept.columns == ["doc_id", "text", "row", "n_chars"]
    found = {r.doc_id: r for r in kept.collect()}
    assert set(found) == {3, 12, 20, 21, 22, 30, 31} and found[12].n_chars == len(found[12].text)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_passage_whose_lines_have_other_owners(spark):
    passage = [f"four words of {n}" for n in range(14)]
    rows = [(1, "\n".join(x for p in passage[::2] for x in (p, f"one's own line, number {p}"))), (2, "\n".join(passage)),
            (3, "\n".join(["mine", *passage, "too"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.deduped_documents(docs).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "mine\ntoo"}


def test_rare_is_relative_to_the_documents(spark, monkeypatch):
    monkeypatch.setattr(L, "FEW", 2)
    template, passage = (" ".join(f"{c}{i}" for i in range(30)) for c in "tp")
    docs = spark.createDataFrame([(i, "\n".join([template, f"own {i}"] + [passage] * (i % 3 == 0))) for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).selectExpr("row.doc_id", "text").collect()}
    assert all(got[i].startswith(template) for i in got)  # all documents have it
    assert got[0].endswith(passage) and not any(passage in got[i] for i in got if i)  # a third of them have it
