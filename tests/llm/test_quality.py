import re

from trellis.llm import quality as Q

WORDS = re.compile("[^\x20\x09-\x0d]+")


def direct(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered), len(lines), text.count("!"))


TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "x " * 7, "a\nb\na\n\n  \na \n", "é#ü *$%&|<>!",
         "one two three four five six seven eight nine " * 3 + "end", "w " * 30_000, "a b c\x1cd \U0001F600",
         " ".join(f"u{i}" for i in range(25)), ("p q r s t u v w\n" * 4).strip(), "same line of words\n" * 40]


def test_measurements(spark, documents):
    rows = [(i, t, 1, 1) for i, t in enumerate(TEXTS)] + [(100 + r.doc_id, r.text, 0, 0) for r in documents.limit(150).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, fail_bits int")
    got = {r.row.doc_id: r for r in Q.ledger(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = direct(t)
        assert tuple(got[i][m] for m in Q.MEASURES) == (want[0], want[1], want[2], want[3], want[4], want[5], want[6]), (i, t)
        n_words = want[0]
        assert bool(got[i].fail_bits & Q.mask(Q.BASE)) == (n_words < 20 or 100 * want[4] > 30 * n_words)


def test_policies_and_ablation(spark, documents):
    book = Q.ledger(documents).cache()
    bits = [r.fail_bits for r in book.collect()]
    for name, rules in Q.POLICIES.items():
        m = Q.mask(rules)
        assert sum(r.kept for r in Q.verdicts(book, name).collect()) == sum(not b & m for b in bits)
        rows = {r.rule: r for r in Q.ablation(book, name).collect()}
        assert set(rows) == set(rules)
        for k, (rule, _) in enumerate(Q.RULES):
            if rule in rules:
                assert rows[rule].n_failed == sum(bool(b & 1 << k) for b in bits)
                assert rows[rule].n_only == sum(b & m == 1 << k for b in bits) and rows[rule].n_docs == len(bits)


def test_ablation_of_every_version_in_one_pass(spark, documents):
    book = Q.ledger(documents)
    got = sorted(tuple(r) for r in Q.ablations(book).collect())
    assert got == sorted((v, *r) for v in Q.POLICIES for r in Q.ablation(book, v).collect())
    assert Q.ablations(book.limit(0)).count() == 0


def test_good_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1")
    book = Q.verdicts(Q.ledger(docs.join(good, "doc_id"))).where("n_words >= 20").groupBy("kept").count()
    n = {r.kept: r["count"] for r in book.collect()}
    assert n[True] / sum(n.values()) > 0.98


def test_no_python_and_no_shuffle(spark, documents):
    plan = Q.verdicts(Q.ledger(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark, documents):
    assert Q.verdicts(Q.ledger(documents.limit(0))).count() == 0 and Q.ablation(Q.ledger(documents.limit(0))).count() == 0
