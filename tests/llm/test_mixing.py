"""Water-filling and the mix against a round-by-round computation."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.llm import mixing


def rounds(sizes, weights, epochs=3):
    """Clamp and share out again until no source is above its cap."""
    caps = {s: epochs * n for s, n in sizes.items()}
    clamped, target = set(), {}
    while True:
        pool = sum(sizes.values()) - sum(caps[s] for s in clamped)
        share = sum(weights[s] for s in sizes if s not in clamped)
        target = {s: caps[s] if s in clamped else pool * weights[s] / share for s in sizes}
        over = {s for s in sizes if s not in clamped and target[s] > caps[s] + 1e-9}
        if not over:
            return target
        clamped |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 100_000]) + rng.randrange(5) for i in range(12)}
    sizes["s99"] = 0
    order = sorted(sizes)
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").withColumn("weight", mixing.cyclic_weights())
    got = {r.source: (r.weight, r.target) for r in mixing.water_fill(frame).collect()}
    want = rounds(sizes, weights)
    for s in sizes:
        assert got[s][0] == weights[s] and got[s][1] == pytest.approx(want[s], abs=1e-6)


def test_mix_of_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "é", None]), "x") for i in range(800)]
    rows += [(1000, None, "empty", "x"), (1001, "", "empty", "x"), (None, "q r", "b", "x"), (3, rows[3][1], rows[3][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    mixed = mixing.mix(docs).withColumn("taken", F.col("size") * F.col("repeats"))
    got = mixed.select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs.repartition(7)).withColumn("taken", F.col("size") * F.col("repeats")).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= max([r.size for r in own]) / 2 + 1e-6
    order = sorted({r.source for r in got if r.source is not None}) + [None]
    sizes = {s: sum(r.size for r in got if r.source == s) for s in order}
    want = rounds(sizes, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)})
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert mixing.repeated(mixed).count() == sum(r.taken // r.size for r in got if r.size)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [(r.target, r.repeats) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b", None), (1, "a b", None)], "doc_id long, text string, source string")
    assert sorted((r.target, r.repeats) for r in mixing.mix(one).collect()) == [(4.0, 1)] * 2
