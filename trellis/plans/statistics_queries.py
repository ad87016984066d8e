"""Registered queries for rollout statistics (G*) and metric roll-ups (I*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import math as M
from trellis.functions import text as T
from trellis.operators import advantages as A
from trellis.operators import metrics as MT
from trellis.plans import sqlkit as Q
from trellis.plans.registry import finish, register
from trellis.sources import views as V

SEQ = ["user_id", "piece"]
TOK = f"WITH {Q.TOKENS}"
W_SUFFIX = "OVER (PARTITION BY user_id, piece ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
W_PREFIX = "OVER (PARTITION BY user_id, piece ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W_SEQ = "OVER (PARTITION BY user_id, piece ORDER BY pos)"


def _whiten_sql(src: str, x: str) -> str:
    return (f"st AS (SELECT sum({x} * mask) / sum(mask) AS mu, var_samp(CASE WHEN mask <> 0 THEN {x} END) AS va "
            f"FROM {src})")


@register("g1_masked_mean", TOK + f"""
SELECT user_id, piece, {Q.r6('sum(score * mask) / nullif(sum(mask), 0)')} AS masked_mean,
       {Q.r6('sum(mask)')} AS mask_sum
FROM tokens GROUP BY user_id, piece""")
def g1_masked_mean(spark, sf_dir):
    return finish(A.masked_mean_by(V.tokens(spark, sf_dir), "score", "mask", SEQ))


@register("g2_masked_var", TOK + f"""
SELECT count(*) FILTER (WHERE mask <> 0) AS n_valid, {Q.r6('sum(score * mask) / sum(mask)')} AS mean,
       {Q.r6('var_samp(CASE WHEN mask <> 0 THEN score END)')} AS var FROM tokens""")
def g2_masked_var(spark, sf_dir):
    return finish(A.masked_moments(V.tokens(spark, sf_dir), "score", "mask"))


@register("g3_masked_whiten", TOK + f""", {_whiten_sql('tokens', 'score')}
SELECT user_id, piece, pos, {Q.r6('(score - mu) / sqrt(va + 1e-8)')} AS whitened FROM tokens, st""")
def g3_masked_whiten(spark, sf_dir):
    out = A.masked_whiten(V.tokens(spark, sf_dir), "score", "mask", "whitened")
    return finish(out.select("user_id", "piece", "pos", "whitened"))


@register("g4_clip_by_value", TOK + f"""
SELECT user_id, piece, pos, {Q.r6('greatest(least(score, 50.0), 5.0)')} AS clipped FROM tokens""")
def g4_clip_by_value(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    return finish(t.select("user_id", "piece", "pos", M.clip_by_value("score", 5.0, 50.0).alias("clipped")))


@register("g5_kl_penalty", TOK + f"""
SELECT user_id, piece, pos, {Q.r6('old_lp - ref_lp')} AS kl, {Q.r6('abs(old_lp - ref_lp)')} AS kl_abs,
       {Q.r6('0.5 * (old_lp - ref_lp) * (old_lp - ref_lp)')} AS kl_mse,
       {Q.r6('greatest(least(exp(ref_lp - old_lp) - (ref_lp - old_lp) - 1, 10.0), -10.0)')} AS low_var_kl
FROM tokens""")
def g5_kl_penalty(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    return finish(t.select("user_id", "piece", "pos",
                           *[M.kl_penalty("old_lp", "ref_lp", k).alias(n) for k, n in
                             (("kl", "kl"), ("abs", "kl_abs"), ("mse", "kl_mse"), ("low_var_kl", "low_var_kl"))]))


_BETA = 0.05


@register("g6_apply_kl_penalty", TOK + f"""
SELECT user_id, piece, pos, {Q.r6(f'score - {_BETA} * (old_lp - ref_lp) * mask')} AS token_level_rewards
FROM tokens""")
def g6_apply_kl_penalty(spark, sf_dir):
    out = A.apply_kl_penalty(V.tokens(spark, sf_dir), SEQ, _BETA)
    return finish(out.select("user_id", "piece", "pos", "token_level_rewards"))


@register("g6_kl_report", TOK + f""",
per_seq AS (SELECT sum((old_lp - ref_lp) * mask * mask) / nullif(sum(mask), 0) AS m FROM tokens GROUP BY user_id, piece)
SELECT {Q.r6('avg(m)')} AS current_kl, {_BETA}::DOUBLE AS kl_coeff FROM per_seq""")
def g6_kl_report(spark, sf_dir):
    pen = A.apply_kl_penalty(V.tokens(spark, sf_dir), SEQ, _BETA)
    return finish(A.kl_report(pen, SEQ, _BETA))


@register("g7_compute_rewards", TOK + f"""
SELECT user_id, piece, pos, {Q.r6('score - (old_lp - ref_lp) * 0.1')} AS rewards FROM tokens""")
def g7_compute_rewards(spark, sf_dir):
    out = A.compute_rewards(V.tokens(spark, sf_dir), 0.1)
    return finish(out.select("user_id", "piece", "pos", "rewards"))


_G, _L = 0.99, 0.95


#: The same sums as recursions from the last position back.
_RECURSIVE = TOK.replace("WITH", "WITH RECURSIVE", 1)
_GAE_SQL = f"""
d AS (SELECT *, score + {_G} * coalesce(lead(vals) {W_SEQ}, 0.0) - vals AS delta,
             pos = max(pos) OVER (PARTITION BY user_id, piece) AS is_last FROM tokens),
a AS (
  SELECT *, delta AS adv_raw FROM d WHERE is_last
  UNION ALL SELECT d.*, d.delta + {_G * _L} * a.adv_raw FROM a JOIN d ON d.user_id = a.user_id AND d.piece = a.piece AND d.pos = a.pos - 1)"""
_RETURN_SQL = f"""
e AS (SELECT *, pos = max(pos) OVER (PARTITION BY user_id, piece) AS is_last FROM tokens),
r AS (
  SELECT *, score AS returns FROM e WHERE is_last
  UNION ALL SELECT e.*, e.score + {_G} * CASE WHEN r.mask <> 0 THEN r.returns ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.piece = r.piece AND e.pos = r.pos - 1)"""


@register("g8_gae", _RECURSIVE + f""",{_GAE_SQL},
{_whiten_sql('a', 'adv_raw')}
SELECT user_id, piece, pos, {Q.r6('(adv_raw - mu) / sqrt(va + 1e-8)')} AS advantages,
       {Q.r6('adv_raw + vals')} AS returns FROM a, st""")
def g8_gae(spark, sf_dir):
    out = A.gae(V.tokens(spark, sf_dir), SEQ, reward="score", gamma=_G, lam=_L)
    return finish(out.select("user_id", "piece", "pos", "advantages", "returns"))


_GROUP_STATS = f"WITH {Q.GROUPS}, gs AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM groups GROUP BY uid)"


def _groups(spark, sf_dir):
    return V.evenly_dealt(V.groups(spark, sf_dir), sf_dir, "lineitem", ["uid"])


@register("g9_grpo", _GROUP_STATS + f"""
SELECT g.uid, g.sample_id, g.score,
       {Q.r6('(g.score - CASE WHEN n = 1 THEN 0.0 ELSE m END) / (CASE WHEN n = 1 THEN 1.0 ELSE sd END + 1e-6)')} AS advantages
FROM groups g JOIN gs ON gs.uid = g.uid""")
def g9_grpo(spark, sf_dir):
    out = A.grpo(_groups(spark, sf_dir))
    return finish(out.select("uid", "sample_id", "score", "advantages"))


@register("g10_rloo", _GROUP_STATS + f"""
SELECT g.uid, g.sample_id, g.score,
       {Q.r6('CASE WHEN n > 1 THEN g.score * n / (n - 1) - m * n / (n - 1) ELSE g.score END')} AS advantages
FROM groups g JOIN gs ON gs.uid = g.uid""")
def g10_rloo(spark, sf_dir):
    out = A.rloo(_groups(spark, sf_dir))
    return finish(out.select("uid", "sample_id", "score", "advantages"))


@register("g11_reinforce_pp", _RECURSIVE + f""",{_RETURN_SQL},
{_whiten_sql('r', 'returns')}
SELECT user_id, piece, pos, {Q.r6('(returns - mu) / sqrt(va + 1e-8) * mask')} AS advantages,
       {Q.r6('returns')} AS returns FROM r, st""")
def g11_reinforce_pp(spark, sf_dir):
    out = A.reinforce_pp(V.tokens(spark, sf_dir), SEQ, reward="score", gamma=_G)
    return finish(out.select("user_id", "piece", "pos", "advantages", "returns"))


def _baselines(tokens):
    # the greedy pass's score: the smallest token score of the sequence
    return tokens.groupBy(*SEQ).agg(F.min("score").alias("baseline"))


_BASE_SQL = "b AS (SELECT user_id, piece, min(score) AS baseline FROM tokens GROUP BY user_id, piece)"


@register("g12_remax", TOK + f""", {_BASE_SQL},
j AS (SELECT t.*, b.baseline FROM tokens t LEFT JOIN b USING (user_id, piece))
SELECT user_id, piece, pos, {Q.r6(f'sum(score * mask) {W_SUFFIX}')} AS returns,
       {Q.r6(f'sum(score * mask) {W_SUFFIX} - baseline * mask')} AS advantages FROM j""")
def g12_remax(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    out = A.remax(A.greedy_baseline(t, _baselines(t), SEQ), SEQ, reward="score")
    return finish(out.select("user_id", "piece", "pos", "returns", "advantages"))


_DISPATCH_SQL = _RECURSIVE + f""",{_GAE_SQL},{_RETURN_SQL},
sa AS (SELECT sum(adv_raw * mask) / sum(mask) AS mu, var_samp(CASE WHEN mask <> 0 THEN adv_raw END) AS va FROM a),
gae AS (SELECT (adv_raw - mu) / sqrt(va + 1e-8) AS adv FROM a, sa),
sr AS (SELECT sum(returns * mask) / sum(mask) AS mu, var_samp(CASE WHEN mask <> 0 THEN returns END) AS va FROM r),
rpp AS (SELECT (returns - mu) / sqrt(va + 1e-8) * mask AS adv FROM r, sr),
b AS (SELECT user_id, piece, min(score) AS baseline FROM tokens GROUP BY user_id, piece),
rmx AS (SELECT sum(t.score * t.mask) OVER (PARTITION BY t.user_id, t.piece ORDER BY t.pos
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - b.baseline * t.mask AS adv
        FROM tokens t JOIN b ON b.user_id = t.user_id AND b.piece = t.piece),
{Q.GROUPS.strip()},
gs AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM groups GROUP BY uid),
grpo AS (SELECT (g.score - CASE WHEN n = 1 THEN 0.0 ELSE m END) / (CASE WHEN n = 1 THEN 1.0 ELSE sd END + 1e-6) AS adv
         FROM groups g JOIN gs ON gs.uid = g.uid),
rloo AS (SELECT CASE WHEN n > 1 THEN g.score * n / (n - 1) - m * n / (n - 1) ELSE g.score END AS adv
         FROM groups g JOIN gs ON gs.uid = g.uid)
SELECT 'gae' AS kind, count(*) AS n, {Q.r6('avg(adv)')} AS mean_advantage FROM gae
UNION ALL SELECT 'reinforce_plus_plus', count(*), {Q.r6('avg(adv)')} FROM rpp
UNION ALL SELECT 'remax', count(*), {Q.r6('avg(adv)')} FROM rmx
UNION ALL SELECT 'grpo', count(*), {Q.r6('avg(adv)')} FROM grpo
UNION ALL SELECT 'rloo', count(*), {Q.r6('avg(adv)')} FROM rloo"""


@register("g13_advantage_dispatch", _DISPATCH_SQL)
def g13_advantage_dispatch(spark, sf_dir):
    """All five estimators through the dispatcher; per kind: rows and mean."""
    t = V.evenly_dealt(V.tokens(spark, sf_dir), sf_dir, "events", SEQ)
    g = _groups(spark, sf_dir)
    parts = [
        A.compute_advantage(t, "gae", seq_keys=SEQ, reward="score", gamma=_G, lam=_L).select(F.lit("gae").alias("kind"), "advantages"),
        A.compute_advantage(t, "reinforce_plus_plus", seq_keys=SEQ, reward="score", gamma=_G).select(F.lit("reinforce_plus_plus").alias("kind"), "advantages"),
        A.compute_advantage(A.greedy_baseline(t, _baselines(t), SEQ), "remax", seq_keys=SEQ, reward="score").select(F.lit("remax").alias("kind"), "advantages"),
        A.compute_advantage(g, "grpo").select(F.lit("grpo").alias("kind"), "advantages"),
        A.compute_advantage(g, "rloo").select(F.lit("rloo").alias("kind"), "advantages"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return finish(u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("advantages").alias("mean_advantage")))


@register("g14_greedy_baseline", TOK + f""", {_BASE_SQL}
SELECT user_id, piece, {Q.r6('baseline')} AS baseline FROM b""")
def g14_greedy_baseline(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    seqs = t.select(*SEQ).distinct()
    return finish(A.greedy_baseline(seqs, _baselines(t), SEQ))


_KL_INIT, _KL_TARGET, _KL_HORIZON = 0.001, 0.008, 1000.0
_MULT = f"(1 + greatest(least(kl / {_KL_TARGET} - 1, 0.2), -0.2) * n / {_KL_HORIZON})"


@register("g15_adaptive_kl", f"""WITH {Q.STEP_LOG},
m AS (SELECT run, step, {_MULT} AS mult FROM step_log)
SELECT run, step,
  {Q.r6(f"{_KL_INIT} * exp(coalesce(sum(ln(mult)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))")} AS kl_coef,
  {Q.r6(f"{_KL_INIT} * exp(sum(ln(mult)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")} AS kl_coef_next
FROM m""")
def g15_adaptive_kl(spark, sf_dir):
    out = A.adaptive_kl(V.step_log(spark, sf_dir), _KL_INIT, _KL_TARGET, _KL_HORIZON)
    return finish(out.select("run", "step", "kl_coef", "kl_coef_next"))


@register("g16_fixed_kl", f"""WITH {Q.STEP_LOG}
SELECT run, step, 0.001::DOUBLE AS kl_coef, 0.001::DOUBLE AS kl_coef_next FROM step_log""")
def g16_fixed_kl(spark, sf_dir):
    out = A.fixed_kl(V.step_log(spark, sf_dir), 0.001)
    return finish(out.select("run", "step", "kl_coef", "kl_coef_next"))


_MB = "user_id // 40"


def _with_mb(t):
    return t.withColumn("mb", (F.col("user_id") / 40).cast("long")) \
        .withColumn("advantages", (F.col("score") - F.col("vals")) / 10.0)


@register("g17_policy_loss_report", TOK + f""",
x AS (SELECT {_MB} AS mb, *, (score - vals) / 10.0 AS adv, exp(lp - old_lp) AS ratio FROM tokens),
y AS (SELECT *, -adv * ratio AS l1, -adv * greatest(least(ratio, 1.2), 0.8) AS l2 FROM x)
SELECT mb, {Q.r6('sum(greatest(l1, l2) * mask) / nullif(sum(mask), 0)')} AS pg_loss,
       {Q.r6('sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / nullif(sum(mask), 0)')} AS pg_clipfrac,
       {Q.r6('sum((old_lp - lp) * mask) / nullif(sum(mask), 0)')} AS ppo_kl
FROM y GROUP BY mb""")
def g17_policy_loss_report(spark, sf_dir):
    t = _with_mb(V.tokens(spark, sf_dir))
    return finish(A.policy_loss_report(t, ["mb"], 0.2))


@register("g18_value_loss_report", TOK + f""",
x AS (SELECT {_MB} AS mb, *, greatest(least(vpred, vals + 0.5), vals - 0.5) AS vclip FROM tokens),
y AS (SELECT *, (vpred - score) * (vpred - score) AS l1, (vclip - score) * (vclip - score) AS l2 FROM x)
SELECT mb, {Q.r6('0.5 * sum(greatest(l1, l2) * mask) / nullif(sum(mask), 0)')} AS vf_loss,
       {Q.r6('sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / nullif(sum(mask), 0)')} AS vf_clipfrac,
       {Q.r6('sum(vpred * mask) / nullif(sum(mask), 0)')} AS vpred_mean
FROM y GROUP BY mb""")
def g18_value_loss_report(spark, sf_dir):
    t = _with_mb(V.tokens(spark, sf_dir))
    return finish(A.value_loss_report(t, ["mb"], 0.5, returns="score"))


_LOGITS = "lg AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings)"


def _lse_sql(arr: str) -> str:
    return f"(list_max({arr}) + ln(list_sum(list_transform({arr}, lambda x: exp(x - list_max({arr}))))))"


@register("g19_entropy", f"""WITH {_LOGITS}
SELECT vec_id, {Q.r6(f"{_lse_sql('l')} - list_sum(list_transform(l, lambda x: exp(x - {_lse_sql('l')}) * x))")} AS entropy
FROM lg""")
def g19_entropy(spark, sf_dir):
    lg = V.logits(spark, sf_dir)
    return finish(lg.select("vec_id", M.entropy_from_logits("logits").alias("entropy")))


@register("g20_token_logprob", f"""WITH {_LOGITS},
t AS (SELECT vec_id, label, l, list_transform(l, lambda x: x / 0.7) AS l7 FROM lg)
SELECT vec_id, {Q.r6(f"l[label + 1] - {_lse_sql('l')}")} AS logprob,
       {Q.r6(f"l7[label + 1] - {_lse_sql('l7')}")} AS logprob_t07 FROM t""")
def g20_token_logprob(spark, sf_dir):
    lg = V.logits(spark, sf_dir)
    return finish(lg.select("vec_id", M.token_logprob("logits", "label").alias("logprob"),
                            M.token_logprob("logits", "label", 0.7).alias("logprob_t07")))


@register("g21_actor_objective_report", f"""WITH {_LOGITS},
t AS (SELECT vec_id // 64 AS mb, label, l, list_transform(l, lambda x: x / 1.1) AS lo,
             list_transform(l, lambda x: x / 1.2) AS lr FROM lg),
u AS (SELECT mb, l[label + 1] - {_lse_sql('l')} AS lp, lo[label + 1] - {_lse_sql('lo')} AS old_lp,
             lr[label + 1] - {_lse_sql('lr')} AS ref_lp, (label - 4.5) / 4.5 AS adv,
             {_lse_sql('l')} - list_sum(list_transform(l, lambda x: exp(x - {_lse_sql('l')}) * x)) AS ent FROM t),
v AS (SELECT *, exp(lp - old_lp) AS ratio FROM u),
w AS (SELECT mb, greatest(-adv * ratio, -adv * greatest(least(ratio, 1.2), 0.8)) AS pg, ent,
             greatest(least(exp(ref_lp - lp) - (ref_lp - lp) - 1, 10.0), -10.0) AS kl FROM v)
SELECT mb, {Q.r6('avg(pg)')} AS pg_loss, {Q.r6('avg(ent)')} AS entropy_loss, {Q.r6('avg(kl)')} AS kl_loss,
       {Q.r6('avg(pg) - avg(ent) * 0.001 + avg(kl) * 0.01')} AS policy_loss FROM w GROUP BY mb""")
def g21_actor_objective_report(spark, sf_dir):
    lg = V.logits(spark, sf_dir)
    t = lg.select((F.col("vec_id") / 64).cast("long").alias("mb"), F.lit(1).alias("mask"),
                  M.token_logprob("logits", "label").alias("lp"),
                  M.token_logprob("logits", "label", 1.1).alias("old_lp"),
                  M.token_logprob("logits", "label", 1.2).alias("ref_lp"),
                  ((F.col("label") - 4.5) / 4.5).alias("advantages"),
                  M.entropy_from_logits("logits").alias("entropy"))
    return finish(A.actor_objective_report(t, ["mb"], 0.2, 0.001, 0.01))


@register("g22_critic_value_mask", TOK + f"""
SELECT user_id, piece, pos, coalesce(lag(mask) {W_SEQ}, 1) AS critic_mask,
       {Q.r6(f'vals * coalesce(lag(mask) {W_SEQ}, 1)')} AS masked_values FROM tokens""")
def g22_critic_value_mask(spark, sf_dir):
    out = A.critic_value_mask(V.tokens(spark, sf_dir), SEQ)
    return finish(out.select("user_id", "piece", "pos", "critic_mask", "masked_values"))


# ------------------------------------------------------------------ I*

def _metric_long(spark, sf_dir):
    sl = V.step_log(spark, sf_dir)
    return MT.to_long(sl, ["run", "step"], {"kl": "kl", "n": "n", "seconds": "seconds"})


_METRIC_LONG = f"""WITH {Q.STEP_LOG},
ml AS (SELECT run, step, 'kl' AS name, kl AS value FROM step_log
       UNION ALL SELECT run, step, 'n', n::DOUBLE FROM step_log
       UNION ALL SELECT run, step, 'seconds', seconds FROM step_log)"""


@register("i1_reduce_metrics", _METRIC_LONG + f"""
SELECT run, name, {Q.r6('avg(value)')} AS value FROM ml GROUP BY run, name""")
def i1_reduce_metrics(spark, sf_dir):
    return finish(MT.reduce_metrics(_metric_long(spark, sf_dir), ["run", "name"]))


@register("a8_log_metrics", _METRIC_LONG + """,
s AS (SELECT step, name, avg(value) AS value FROM ml GROUP BY step, name)
SELECT step, 'step ' || step || ': - ' || string_agg(name || ':' || printf('%.3f', value), ' - ' ORDER BY name) AS line
FROM s GROUP BY step""")
def a8_log_metrics(spark, sf_dir):
    per_step = MT.reduce_metrics(_metric_long(spark, sf_dir), ["step", "name"])
    return MT.console_lines(per_step)


@register("i2_data_metrics", TOK + f""",
pen AS (SELECT *, score - {_BETA} * (old_lp - ref_lp) * mask AS tlr FROM tokens),
d AS (SELECT *, tlr + {_G} * coalesce(lead(vals) {W_SEQ}, 0.0) - vals AS delta FROM pen),
a AS (SELECT *, sum(delta * power({_G * _L}, pos)) {W_SUFFIX} / power({_G * _L}, pos) AS adv_raw FROM d),
{_whiten_sql('a', 'adv_raw')},
f AS (SELECT a.*, (adv_raw - mu) / sqrt(va + 1e-8) AS adv, adv_raw + vals AS ret FROM a, st),
sq AS (SELECT sum(score) AS s, sum(tlr) AS r, sum(mask)::DOUBLE AS rl FROM f GROUP BY user_id, piece),
s1 AS (SELECT avg(s) a1, max(s) a2, min(s) a3, avg(r) b1, max(r) b2, min(r) b3, avg(rl) c1, max(rl) c2, min(rl) c3,
              avg(CASE WHEN rl = 128 THEN 1.0 ELSE 0.0 END) c4 FROM sq),
s2 AS (SELECT avg(adv) d1, max(adv) d2, min(adv) d3, avg(ret) e1, max(ret) e2, min(ret) e3,
              avg(vals) v1, max(vals) v2, min(vals) v3, 1.0 - var_samp(ret - vals) / (var_samp(ret) + 1e-5) ev
       FROM f WHERE mask <> 0),
w AS (SELECT * FROM s1, s2)
SELECT name, {Q.r6('value')} AS value FROM (
  SELECT 'critic/score/mean' AS name, a1 AS value FROM w UNION ALL SELECT 'critic/score/max', a2 FROM w
  UNION ALL SELECT 'critic/score/min', a3 FROM w UNION ALL SELECT 'critic/rewards/mean', b1 FROM w
  UNION ALL SELECT 'critic/rewards/max', b2 FROM w UNION ALL SELECT 'critic/rewards/min', b3 FROM w
  UNION ALL SELECT 'response_length/mean', c1 FROM w UNION ALL SELECT 'response_length/max', c2 FROM w
  UNION ALL SELECT 'response_length/min', c3 FROM w UNION ALL SELECT 'response_length/clip_ratio', c4 FROM w
  UNION ALL SELECT 'critic/advantages/mean', d1 FROM w UNION ALL SELECT 'critic/advantages/max', d2 FROM w
  UNION ALL SELECT 'critic/advantages/min', d3 FROM w UNION ALL SELECT 'critic/returns/mean', e1 FROM w
  UNION ALL SELECT 'critic/returns/max', e2 FROM w UNION ALL SELECT 'critic/returns/min', e3 FROM w
  UNION ALL SELECT 'critic/values/mean', v1 FROM w UNION ALL SELECT 'critic/values/max', v2 FROM w
  UNION ALL SELECT 'critic/values/min', v3 FROM w UNION ALL SELECT 'critic/vf_explained_var', ev FROM w)""")
def i2_data_metrics(spark, sf_dir):
    t = A.apply_kl_penalty(V.tokens(spark, sf_dir), SEQ, _BETA)
    t = A.gae(t, SEQ, reward="token_level_rewards", gamma=_G, lam=_L)
    return finish(MT.data_metrics(t, SEQ, 128))


# Section name per event type in the synthetic timing log.
_SECTIONS = {"view": "gen", "click": "ref", "error": "values", "purchase": "adv", "signup": "update_actor"}


def _timing(spark, sf_dir):
    sl = V.step_log(spark, sf_dir)
    sec = F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv])
    timing = sl.select("step", sec[F.col("run")].alias("section"), "seconds")
    toks = sl.groupBy("step").agg(F.sum("n").alias("response_tokens"),
                                  (F.sum("n") * 2).alias("prompt_tokens"))
    return timing, toks


_TIMING_SQL = f"""WITH {Q.STEP_LOG},
timing AS (SELECT step, CASE run WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'error' THEN 'values'
                  WHEN 'purchase' THEN 'adv' WHEN 'signup' THEN 'update_actor' END AS section, seconds FROM step_log),
toks AS (SELECT step, sum(n) AS response_tokens, sum(n) * 2 AS prompt_tokens FROM step_log GROUP BY step)"""


@register("i3_timing_metrics", _TIMING_SQL + f"""
SELECT step, 'timing_s/' || section AS name, {Q.r6('seconds')} AS value FROM timing
UNION ALL
SELECT t.step, 'timing_per_token_ms/' || section,
       {Q.r6("seconds * 1000.0 / CASE WHEN section = 'gen' THEN response_tokens ELSE prompt_tokens + response_tokens END")}
FROM timing t JOIN toks k ON k.step = t.step""")
def i3_timing_metrics(spark, sf_dir):
    timing, toks = _timing(spark, sf_dir)
    return finish(MT.timing_metrics(timing, toks))


@register("i4_throughput_metrics", f"""WITH {Q.STEP_LOG}
SELECT step, sum(n)::DOUBLE * 3 AS "perf/total_num_tokens", {Q.r6('sum(seconds)')} AS "perf/time_per_step",
       {Q.r6('sum(n) * 3 / (sum(seconds) * 8)')} AS "perf/throughput" FROM step_log GROUP BY step""")
def i4_throughput_metrics(spark, sf_dir):
    sl = V.step_log(spark, sf_dir)
    per = sl.groupBy("step").agg((F.sum("n") * 3).alias("total_tokens"), F.sum("seconds").alias("step_seconds"))
    return finish(MT.throughput_metrics(per, 8))


# A 7B decoder shape for the flops report.
_MODEL = dict(model_type="qwen2", hidden=3584, vocab=152064, layers=28, heads=28, kv_heads=4, intermediate=18944)


@register("i5_flops_report", """
WITH l AS (SELECT source AS batch_id, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS n
           FROM documents),
a AS (SELECT batch_id, sum(n)::DOUBLE AS tokens_sum, sum(n::DOUBLE * n) AS sq_sum FROM l GROUP BY batch_id)
SELECT batch_id, tokens_sum, sq_sum,
       round((6.0 * ((3584::BIGINT * 18944 * 3 + 3584::BIGINT * (3584 + 512 + 512 + 3584)) * 28 + 152064::BIGINT * 3584 * 2) * tokens_sum
              + 12.0 * 128 * 28 * 28 * sq_sum) / 10.0 / 1e12, 6) + 0.0 AS tflops_achieved,
       round((6.0 * ((3584::BIGINT * 18944 * 3 + 3584::BIGINT * (3584 + 512 + 512 + 3584)) * 28 + 152064::BIGINT * 3584 * 2) * tokens_sum
              + 12.0 * 128 * 28 * 28 * sq_sum) / 10.0 / 1e12 / (989.0 * 8), 6) + 0.0 AS mfu
FROM a""")
def i5_flops_report(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    lens = d.select(F.col("source").alias("batch_id"), T.word_count("text").alias("n_tokens"), F.lit(10.0).alias("secs"))
    return finish(MT.flops_report(lens, "batch_id", "n_tokens", "secs", _MODEL, "NVIDIA H100 80GB", 8))
