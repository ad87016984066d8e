"""Golden rows (FIXTURES.md §3), derived by hand from the operator definitions."""

import math

import pytest
from pyspark.sql import functions as F

from support import one
from trellis.functions import arrays as AR
from trellis.functions import evaluate as E
from trellis.functions import math as M
from trellis.functions import rewards as R
from trellis.functions import text as T
from trellis.functions.similarity import soft_hits
from trellis.operators import advantages as A
from trellis.operators import balance as H
from trellis.operators import batch as B
from trellis.operators import metrics as MT
from trellis.operators import prompts as P
from trellis.operators import rewards as OR


def _resp(spark, rows):
    return spark.createDataFrame(rows, "row_id long, response string, ground_truth string, context string")


def test_e8_golden(spark):
    ctx = "It is said that Paris is big and old."
    df = _resp(spark, [
        (0, "<think>x <retrieval>Paris is big</retrieval></think> Answer: Paris", "Paris", ctx),
        (1, "<think>x</think> Answer: Paris", "Paris", ctx),
        (2, "", "Paris", ctx),
        (3, "<think>x</think> <retrieval>Paris is big</retrieval> Answer: Paris", "Paris", ctx),
    ])
    got = {r.row_id: r.reward for r in OR.score_evidence(df, "row_id").collect()}
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.74)
    assert got[2] == pytest.approx(0.04)
    assert got[3] == pytest.approx(0.9)


def test_e7_exact_soft_absent(spark):
    ctx = "the river flows through paris is big town and more"
    resp = ("<think><retrieval>river flows through</retrieval><retrieval>Paris is big</retrieval>"
            "<retrieval>zebra quantum lattice</retrieval></think> Answer: x")
    out = one(OR.score_evidence(_resp(spark, [(0, resp, "x", ctx)]), "row_id"))
    assert out.span_score == pytest.approx(0.5)


def test_e5_e6_case(spark):
    assert not ("Paris is big" in "paris is big")
    assert soft_hits(["Paris is big", "", "  "], "paris is big") == [True, False, False]
    assert soft_hits(["paris is the capital of france"], "paris is the capitol of france") == [True]
    assert soft_hits(["one two three four"], "one two") == [False]


def test_e6_junk_heuristic():
    base = "ab " * 103
    span = base.strip()
    changed = span[:150] + "x" + span[151:]
    assert len(span) >= 200
    # one changed letter: the default junk heuristic drops the ratio far below 0.85
    assert soft_hits([span], changed) == [False]


def test_e2_e3_e13(spark):
    df = spark.createDataFrame([("Answer: a Answer: b", "the the cat", "the cat", "Paris.", "Paris",
                                 "<answer>4\n2</answer>", "42")],
                               "r string, a string, g string, a2 string, g2 string, t string, tt string")
    row = one(df.select(R.extract_answer("r").alias("ans"), R.set_f1("a", "g").alias("f1"),
                        R.set_f1("a2", "g2").alias("f1b"), R.tagged_accuracy("t", "tt").alias("acc"),
                        R.tagged_answer("t").alias("tans")))
    assert row.ans == "a Answer: b"
    assert row.f1 == pytest.approx(1.0)
    assert row.f1b == 0.0
    assert row.acc == 0.0
    assert row.tans == "<answer>4\n2</answer>"


def test_e16_place(spark):
    df = spark.createDataFrame([(2, 0.5), (0, 0.5)], "response_len int, reward double")
    got = [r.token_level_scores for r in OR.place_rewards(df, 4).collect()]
    assert got == [[0.0, 0.5, 0.0, 0.0], [0.0, 0.0, 0.0, 0.5]]


def test_f_metrics(spark):
    df = spark.createDataFrame([("The cat, a.b!", "The cat, sat.", "a cat sat down", "cat cat", "cat")],
                               "s string, p string, g string, p2 string, g2 string")
    row = one(df.select(T.normalize_answer("s").alias("n"), E.qa_f1("p", "g").alias("f"),
                        E.qa_f1("p2", "g2").alias("f2")))
    assert row.n == "cat ab"
    assert row.f == pytest.approx(0.8)
    assert row.f2 == pytest.approx(2 / 3)


def test_f8_classification_skip(spark):
    df = spark.createDataFrame([("abc", "abc", ["a", "ab", "abc"])], "p string, t string, c array<string>")
    assert one(df.select(E.classification("p", "t", "c").alias("s"))).s == pytest.approx(0.5)


def test_f9_f11(spark):
    df = spark.createDataFrame([("Paragraph 12 and 1", "Paragraph 12", "3 or 4", "none")],
                               "p string, t string, p2 string, p3 string")
    row = one(df.select(E.passage_id_en("p", "t").alias("a"), E.count_match("p2", F.lit("3")).alias("b"),
                        E.count_match("p3", F.lit("3")).alias("c")))
    assert (row.a, row.b, row.c) == (0.5, 0.5, 0.0)


def test_f13_f14_f17(spark):
    df = spark.createDataFrame([("trec", "\n\nfoo\nbar", [], 3999), ("x", "y", [], 4000),
                                ("x", "y", [], 7999), ("x", "y", [], 8000)],
                               "dataset string, pred string, answers array<string>, length int")
    rows = df.select(E.first_line_if("dataset", "pred").alias("fl"),
                     E.best_of("answers", lambda a: E.qa_f1(F.col("pred"), a)).alias("best"),
                     E.length_bucket("length").alias("b")).collect()
    assert rows[0].fl == "foo"
    assert all(r.best == 0.0 for r in rows)
    assert [r.b for r in rows] == ["0-4k", "4-8k", "4-8k", "8k+"]


def test_c17(spark):
    df = spark.createDataFrame([("full response",), ("x Answer:",)], "r string")
    got = [r.s for r in df.select(P.strip_markers("r", "Qwen2.5-tuned", "tuned").alias("s")).collect()]
    assert got == ["full response", ""]


def test_c_arrays(spark):
    df = spark.createDataFrame([(list(range(1, 11)), [1, 2, 3], list(range(1, 7)), [0, 0, 1, 1, 1],
                                 [0, 0, 2, 42, 3, 5, 1, 0, 0])],
                               "t array<bigint>, ids array<bigint>, six array<bigint>, m array<bigint>, e array<bigint>")
    row = one(df.select(AR.middle_truncate("t", 5).alias("mt"),
                        AR.pad_or_truncate("ids", 5, 0, True, "right").alias("pad"),
                        AR.pad_or_truncate("six", 4, 0, True, "right").alias("r"),
                        AR.pad_or_truncate("six", 4, 0, True, "left").alias("l"),
                        AR.position_ids("m").alias("pos"), AR.eos_mask("e", 1).alias("eos")))
    assert row.mt == [1, 2, 9, 10]
    assert row.pad == [0, 0, 1, 2, 3]
    assert row.r == [1, 2, 3, 4] and row.l == [3, 4, 5, 6]
    assert row.pos == [0, 0, 0, 1, 2]
    assert row.eos == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    with pytest.raises(Exception):
        df.select(AR.pad_or_truncate("six", 4, 0, True, "error")).collect()


def test_c9_c10(spark):
    df = spark.createDataFrame([([1],), ([2, 3],)], "a array<bigint>")
    w = df.select(F.max(F.size("a"))).scalar()
    assert {len(r.p) for r in df.select(AR.pad_ragged("a", 4, 0).alias("p")).collect()} == {4}
    assert {len(r.p) for r in df.select(AR.pad_ragged("a", F.greatest(w, F.lit(0)), 0).alias("p")).collect()} == {2}
    roll = spark.createDataFrame([([0, 0, 0, 0, 5, 6, 7, 8], [0, 0, 0, 0, 1, 1, 1, 1], [9, 9, 2, 4, 4, 4, 4, 4])],
                                 "p array<bigint>, pm array<bigint>, r array<bigint>")
    roll = roll.withColumn("pp", AR.position_ids("pm"))
    out = one(P.assemble_rollout(roll, "p", "pm", "pp", "r", 8, 2))
    assert out.position_ids == [0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert out.attention_mask == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_b_ops(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, v string")
    padded, pad = B.pad_to_divisor(df, 5)
    assert pad == 3
    assert [r.v for r in padded.orderBy("row_id").collect()] == ["a", "b", "a", "b", "a"]
    assert [r.v for r in B.unpad(padded, pad).orderBy("row_id").collect()] == ["a", "b"]
    assert [r.v for r in B.repeat(df, 2).orderBy("row_id").collect()] == ["a", "a", "b", "b"]
    assert [r.v for r in B.repeat(df, 2, interleave=False).orderBy("row_id").collect()] == ["a", "b", "a", "b"]
    five = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        B.chunk(five, 2)
    other = df.withColumn("v", F.when(F.col("row_id") == 1, "z").otherwise(F.col("v")))
    with pytest.raises(Exception):
        B.union(df, other).collect()


def test_d1(spark):
    from trellis.operators.curriculum import mix_ratio

    df = spark.createDataFrame([(0,), (5000,), (20000,)], "step int")
    assert [r.r for r in df.select(mix_ratio("step", 10000).alias("r")).collect()] == [0.0, 0.25, 0.5]


def test_g_groups(spark):
    g = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 1.0), (1, 0.0), (2, 1.0)], "uid long, score double")
    got = sorted((r.uid, round(r.advantages, 6)) for r in A.grpo(g).collect())
    assert got[0] == (1, round(-0.8660239, 6)) and got[-2] == (1, round(0.8660239, 6))
    assert got[-1][1] == pytest.approx(1 / (1 + 1e-6))
    r = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 0.0), (2, 1.0)], "uid long, score double")
    got = sorted((r.uid, r.advantages) for r in A.rloo(r).collect())
    assert [x for _, x in got] == pytest.approx([-0.5, -0.5, 1.0, 1.0])


def _tok(spark, cols, rows):
    return spark.createDataFrame(rows, cols)


def test_g3_whiten(spark):
    df = _tok(spark, "s long, pos int, x double, mask int", [(0, i, float(i + 1), 1) for i in range(4)])
    got = [r.w for r in A.masked_whiten(df, "x", "mask", "w").orderBy("pos").collect()]
    assert got == pytest.approx([-1.1618950, -0.3872983, 0.3872983, 1.1618950], abs=1e-6)


def test_g8_gae_raw(spark):
    df = _tok(spark, "s long, pos int, reward double, vals double, mask int",
              [(0, 0, 0.0, 0.5, 1), (0, 1, 0.0, 0.4, 1), (0, 2, 1.0, 0.3, 1)])
    w = df.withColumn("_d", F.col("reward") + 0.9 * F.coalesce(F.lead("vals").over(
        __import__("pyspark.sql").sql.Window.partitionBy("s").orderBy("pos")), F.lit(0.0)) - F.col("vals"))
    out = A.discounted_suffix_sum(w, ["s"], "pos", F.col("_d"), 0.9 * 0.8, "adv").orderBy("pos").collect()
    assert [r.adv for r in out] == pytest.approx([0.12928, 0.374, 0.7])
    full = A.gae(df, ["s"], gamma=0.9, lam=0.8).orderBy("pos").collect()
    assert [r.returns for r in full] == pytest.approx([0.62928, 0.774, 1.0])


def test_g11_g12(spark):
    df = _tok(spark, "s long, pos int, reward double, mask int",
              [(0, 0, 0.0, 1), (0, 1, 0.0, 1), (0, 2, 1.0, 1), (0, 3, 0.0, 0)])
    out = A.reinforce_pp(df, ["s"], gamma=1.0).orderBy("pos").collect()
    assert [r.returns for r in out] == [1.0, 1.0, 1.0, 0.0]
    df2 = _tok(spark, "s long, pos int, reward double, mask int, baseline double",
               [(0, 0, 0.0, 1, 0.25), (0, 1, 0.0, 1, 0.25), (0, 2, 1.0, 1, 0.25)])
    out = A.remax(df2, ["s"]).orderBy("pos").collect()
    assert [r.returns for r in out] == [1.0, 1.0, 1.0]
    assert [r.advantages for r in out] == [0.75, 0.75, 0.75]


def test_g5_g15_g17_g18(spark):
    df = spark.createDataFrame([(-1.0, -2.0)], "lp double, ref double")
    row = one(df.select(*[M.kl_penalty("lp", "ref", k).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]))
    assert (row.kl, row.abs, row.mse) == (1.0, 1.0, 0.5)
    assert row.low_var_kl == pytest.approx(0.3678794, abs=1e-7)
    with pytest.raises(NotImplementedError):
        M.kl_penalty("lp", "ref", "full")
    steps = spark.createDataFrame([("r", 0, 0.03, 64)], "run string, step int, kl double, n long")
    assert one(A.adaptive_kl(steps, 0.1, 0.02, 1000)).kl_coef_next == pytest.approx(0.10128)
    t = spark.createDataFrame([(0, -1.0, -0.5, 1.0, 1), (0, -1.0, -1.5, -1.0, 1)],
                              "b int, old_lp double, lp double, advantages double, mask int")
    rep = one(A.policy_loss_report(t, ["b"], 0.2))
    assert rep.pg_loss == pytest.approx(-0.2) and rep.pg_clipfrac == 1.0 and rep.ppo_kl == pytest.approx(0.0)
    v = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1), (0, 0.0, 0.0, 0.0, 1)],
                              "b int, vpred double, returns double, vals double, mask int")
    rep = one(A.value_loss_report(v, ["b"], 0.5))
    assert rep.vf_loss == pytest.approx(0.25) and rep.vf_clipfrac == 0.0


def test_g19_g20(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.5, 0.5], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    row = one(df.select(M.entropy_from_logits("a").alias("e"), M.entropy_from_logits("b").alias("e2"),
                        *[M.token_logprob("b", F.lit(i)).alias(f"l{i}") for i in range(3)]))
    assert row.e == pytest.approx(math.log(4))
    assert row.e2 == pytest.approx(0.8323956, abs=1e-6)
    assert [row.l0, row.l1, row.l2] == pytest.approx([-2.4076060, -1.4076060, -0.4076060], abs=1e-6)


def test_h1_h5(spark):
    assert H.differencing([1, 2, 3, 4], 2, True).tolist() in ([0, 1, 1, 0], [1, 0, 0, 1])
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate([1, 2, 3, 4])], "batch string, item int, n int")
    assign = H.balance(df, "batch", "item", "n", 2)
    rep = one(H.unbalance_report(assign, "batch", "item", "n", 2))
    assert (rep.min_before, rep.max_before, rep.diff_before) == (3, 7, 4)
    assert (rep.min_after, rep.max_after, rep.mean) == (5, 5, 5.0)


def test_i3(spark):
    timing = spark.createDataFrame([(0, "gen", 2.0)], "step int, section string, seconds double")
    toks = spark.createDataFrame([(0, 100, 50)], "step int, response_tokens long, prompt_tokens long")
    got = {r.name: r.value for r in MT.timing_metrics(timing, toks).collect()}
    assert got["timing_per_token_ms/gen"] == pytest.approx(20.0)


def test_best_of_token_f1(spark):
    from trellis.operators import evaluate as OE

    df = spark.createDataFrame([(["cat", "sat"], [["a", "cat", "sat", "down"], ["dog"]]), (["x"], [])],
                               "p array<string>, a array<array<string>>")
    got = [r.score for r in OE.best_of_token_f1(df, "p", "a").collect()]
    assert got == pytest.approx([2 * 1.0 * 0.5 / 1.5, 0.0])


def test_fill_template_no_reexpansion(spark):
    df = spark.createDataFrame([("ctx with {input} inside", "Q?")], "context string, input string")
    got = one(df.select(P.fill_template("A {context} B {input} C", {"context": F.col("context"),
                                                                      "input": F.col("input")}).alias("p"))).p
    assert got == "A ctx with {input} inside B Q? C"


def test_parse_path_and_total_steps(spark):
    from trellis.operators.curriculum import total_steps
    from trellis.sources.io import parse_path

    assert parse_path("/data/x.parquet@test") == ("/data/x.parquet", "test")
    assert parse_path("/data/x.parquet") == ("/data/x.parquet", "train")
    assert one(total_steps(spark.range(1000), 32, 2)).total_steps == 62
    assert one(total_steps(spark.range(1000), 32, 2, drop_last=False)).total_steps == 64
    assert one(total_steps(spark.range(1000), 32, 2, 7)).total_steps == 7


def test_micro_batches_strict_limit(spark):
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate([12, 12, 12])], "batch string, item int, n int")
    loose = H.micro_batches(df, "batch", "item", "n", 20)
    assert loose.select("part").distinct().count() == 2  # ceil(36 / 20): one of the two holds 24
    with pytest.raises(Exception, match="over the token limit"):
        H.micro_batches(df, "batch", "item", "n", 20, strict=True).collect()


def test_normalize_zh(spark):
    df = spark.createDataFrame([("Ａb，C d。e!",)], "s string")
    assert one(df.select(T.normalize_zh("s").alias("n"))).n == "ａbcde"


def test_log_metrics_backends(spark):
    from trellis.sources.io import scratch_path

    m = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0)], "step int, name string, value double")
    with pytest.raises(ValueError):
        MT.log_metrics(m, ["console", "hosted"])
    path = scratch_path(spark, "metrics-test")
    lines = MT.log_metrics(m, ["console", "table"], table_path=path).collect()
    assert lines[0].line == "step 1: - a:0.500 - b:2.000"
    assert spark.read.parquet(path).count() >= 2
    assert MT.validation_samples(m, 0) is None
