import math

import pytest

from trellis.llm import licenses as L

TEXTS = [None, "", " .-\n", "Licensed under CC BY-NC 4.0.", "cc by", "CC-BY cc by and the General Public License, all rights reserved. All Rights  Reserved",
         "cc\nby", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "released by the mit under license",
         "this work is licensed under the gnu general public license version 3 " * 2, "accby ccby by cc", "é cc by ü",
         "Permission is hereby granted to any person obtaining a copy of this software free of charge", "word " * 30_000 + "cc by", "MIT", "license under the",
         "redistribution and use in source and binary forms are permitted with or without modification\n" * 3]


def direct(text, threshold=L.THRESHOLD):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = {label: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for p, label in L.PHRASES.items()}
    found = {}
    longest = max(len(re.findall("[0-9a-z]+", t.lower())) for _, t in L.TEMPLATES)
    for begin in range(0, len(words), longest):
        block = set(words[begin:begin + 2 * longest])
        for label, t in L.TEMPLATES:
            t = set(L.template_tokens(t))
            own = [w for w in L.MARKS.get(label, ("mit",)) if w in t]
            if all(w in block for w in own) and len(block & t) >= math.ceil(threshold * len(t) - 1e-9):
                found[label] = max(found.get(label, 0), len(block & t) / len(t))
    return len(words), places, found


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_equals_direct(spark, documents, threshold):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(100 + r.doc_id, r.text, "x", 1) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, at int").repartition(4)
    got = {r.doc_id: r for r in L.scan(docs, threshold).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        n, places, found = direct(t, threshold)
        r = got[i]
        assert r.n_words == n and {k: list(v) for k, v in r.places.asDict().items()} == places, (i, t)
        assert {m.label: m.containment for m in r.matches or []} == pytest.approx(found), (i, t)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.places["cc-by"]) for r in L.scan(docs).collect()) == [(False, [0]), (False, [0]), (True, [0])]
    assert L.scan(docs.limit(0)).count() == 0


def test_no_python(spark, documents):
    plan = L.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this"""


def test_wrapped_notices_and_near_misses(spark):
    filler = " ".join(f"w{i}" for i in range(50))
    cases = {"bsd": BSD, "mpl-2.0": MPL, "mit": "released\nunder\nthe\nMIT\nlicense"}
    rows = [(i, f"{filler[:40 * i]}\n{x}\n{filler}") for i, x in enumerate(cases.values())]
    rows += [(10, "Released under the GPL license"), (11, "the license of the book was released last year under new terms"),
             (12, "Licensed under CC BY 4.0"), (13, " ".join(f"{w} {filler}" for w in "released under the mit license".split()))]
    got = {r.doc_id: [m.label for m in r.matches or []] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(3)] == [[x] for x in cases]
    assert got[10] == got[11] == got[12] == got[13] == []


@pytest.mark.parametrize("label", sorted({label for label, _ in L.TEMPLATES}))
def test_every_template_is_found_anywhere(spark, label):
    notices = [t for name, t in L.TEMPLATES if name == label]
    rows = [(k * 100 + i, " ".join(f"w{n}" for n in range(i)) + " " + t.replace(" ", "\n") + " and more of it " * 9)
            for k, t in enumerate(notices) for i in range(0, 40, 3)]
    found = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(label in [m.label for m in r.matches or []] for r in found)
