import hashlib
import re
from itertools import permutations

from trellis.llm import filteraudit as A

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, source string, text string, row string, part int, filter int, fails int, body int, kind int"
LABELS = "doc_id long, quality int, toxic int, row int"


def failing(doc_id, text, firsts):
    text = text or ""
    words = WORD.findall(text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and firsts.get(text) is not None and doc_id > firsts[text]:
        out.add("E")
    return out


def direct(docs, labels):
    """Every order walked filter by filter, row by row."""
    firsts = {}
    for i, _, t in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(s or "", i, failing(i, t, firsts)) for i, s, t in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(gone)
                fails = [r for r in mine if f in r[2]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[2] == {f} for r in mine),
                                                   sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def run(spark, docs, labels):
    found = A.audit(spark.createDataFrame([(*d, "r", 1, 2, 3, 4, 5) for d in docs], DOCS), spark.createDataFrame([(*x, 1) for x in labels], LABELS))
    assert found.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = found.collect()
    assert all(r.filter == r.filter_order[r.step - 1] for r in rows)
    got = {(r.part, r.filter_order, r.step): list(r[4:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_equals_every_order_walked(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [(1, "a", many), (2, "a", many), (2, "a", many), (3, "a", "SHOUT " * 300), (4, None, None), (5, "", ""), (6, "b", "x | y"),
            (None, "b", many), (7, "b", many + " # "), (8, "é", "word " * 400), (9, "a", "#" * 100_000), (0, "a", "x | y"), (10, None, " \t\n")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (7, None, 1), (99, 1, 1), (6, 1, 0)]
    assert run(spark, docs, labels) == direct(docs, labels)


def test_given_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    want = direct(docs, marks)
    got = {tuple(r[:3]): list(r[4:]) for r in A.audit(documents, labels).collect()}
    assert got == want
    for part in {k[0] for k in got}:  # the shares add up to what all filters remove together, in every order
        total = sum(got[part, "ABCDE", s][6] for s in range(1, 6))
        assert total == 120 * sum(got[part, "ABCDE", s][1] for s in range(1, 6))


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, f"s{i % 2}", "same text") for i in range(600)] + [(i, "s0", hashlib.md5(str(i).encode()).hexdigest()) for i in range(600, 1200)]
    assert run(spark, docs, []) == direct(docs, [])


def test_empty(spark):
    assert A.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
