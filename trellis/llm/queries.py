"""The thin ``opN_<name>`` queries: an operator over its whole table with
production parameters, and the digest columns derived from its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.llm import classifier, decontaminate, filteraudit, katz, langid, licenses, linededup, merkle, mixing, quality, simhash, sitetree, tokencount
from trellis.llm.common import read_table
from trellis.llm.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]


@register("op8_simhash")
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op9_decontaminate", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM iw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, lengths WHERE len(w) >= n),
hits AS (
  SELECT dw.r, dw.p, dw.n, windows.item_id FROM dw JOIN windows
  ON windows.n = dw.n AND windows.s = array_to_string(dw.w[dw.p : dw.p + dw.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS name FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit,
       coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""")
def op9_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "[^\\x20\\x09-\\x0D]+"


@register("op6_mix", f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(chr(31), '0', doc_id::VARCHAR, text)), 1, 13))::BIGINT AS o FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM d GROUP BY source),
fill AS (  -- clamp and share out again, round by round
  SELECT 0 AS round, source, source_size, weight, false AS clamped,
         (SELECT sum(source_size) FROM s)::DOUBLE AS pool, (SELECT sum(weight) FROM s) AS open_weight FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, c,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (c) OVER (), 0))::DOUBLE,
         sum(weight) FILTER (NOT c) OVER ()
  FROM (SELECT *, clamped OR pool / open_weight * weight >= 3 * source_size AS c, count(*) OVER () AS n FROM fill WHERE round <= 40)
  WHERE round < 40),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN 3.0 * source_size ELSE pool / open_weight * weight END::DOUBLE AS target
  FROM fill WHERE round = 40),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         sum(d.size) OVER (PARTITION BY d.source, o >> 40 ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS in_bucket,
         min(o) OVER (PARTITION BY d.source, o >> 40) AS first_o
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, min(start) OVER (PARTITION BY source, o >> 40) AS bucket_start FROM c),
f AS (
  SELECT *, min(CASE WHEN bucket_start < rest AND bucket_start + in_bucket >= rest THEN o >> 40 END) OVER (PARTITION BY source) AS edge FROM e)
SELECT doc_id, size, source_size, round(target, 6) + 0.0 AS target,
       size * (whole + CASE WHEN (o >> 40) < edge OR ((o >> 40) = edge AND start + size / 2.0 <= rest) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM f""")
def op6_mix(spark, sf_dir):
    return mix_digest(mixing.mix(read_table(spark, sf_dir, "documents")))


def mix_digest(mixed):
    return mixed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size",
                        (F.round("target", 6) + F.lit(0.0)).alias("target"), (F.col("size") * F.col("repeats")).alias("taken"))


@register("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    found = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_deleted", "text")


@register("op3_language_mixture")
def op3_language_mixture(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identified(docs.select("doc_id", "text"), docs)
    id_ = F.col("row.doc_id")
    return found.select(id_.cast("long").alias("doc_id"), F.coalesce(~langid.may_train(id_), F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    found = tokencount.token_counts(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


_MASK = quality.mask(quality.POLICIES["v2"])


_LEDGER_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM documents),
v AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p : p + 7], ' ')) AS n FROM v),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(quality.RULES))})::BIGINT AS fail_bits FROM m)"""


@register("op5_quality_ledger", _LEDGER_SQL + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, 'v2' AS policy,
       fail_bits & {quality.mask(quality.BASE)} <> 0 AS base_failed, fail_bits & {_MASK} = 0 AS kept FROM b""")
def op5_quality_ledger(spark, sf_dir):
    book = quality.verdicts(quality.ledger(read_table(spark, sf_dir, "documents")), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.BASE)).cast("long")) != 0
    return book.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "fail_bits", "policy", base.alias("base_failed"), "kept")


_POLICY_ROWS = ", ".join(f"('{version}', '{rule}', {1 << [n for n, _ in quality.RULES].index(rule)}, {quality.mask(rules)})"
                          for version, rules in quality.POLICIES.items() for rule in rules)


@register("quality_policy_ablation", _LEDGER_SQL + f""",
p(policy, rule, bit, mask) AS (VALUES {_POLICY_ROWS})
SELECT policy, rule, sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed,
       sum(CASE WHEN fail_bits & mask = bit THEN 1 ELSE 0 END)::BIGINT AS n_only, count(*) AS n_docs
FROM b, p GROUP BY policy, rule""")
def quality_policy_ablation(spark, sf_dir):
    """The other half of op5: what each rule of each policy version removes alone."""
    return quality.ablations(quality.ledger(read_table(spark, sf_dir, "documents")))


_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATE_ROWS = ", ".join(f"('{label}', {ws!r}::VARCHAR[], {licenses.marks(label, ws)!r}::VARCHAR[])"
                           for label, ws in ((label, licenses.template_tokens(text)) for label, text in licenses.TEMPLATES))
_STRIDE = licenses.stride(licenses.TEMPLATES)


def _phrase_sql(phrase, label):
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"SELECT r, '{label}' AS label, i - 1 AS pos FROM v WHERE {same}"


@register("op7_license_scan", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w, {_LOWERED} AS t FROM documents),
v AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS ({" UNION ALL ".join(_phrase_sql(p, x) for p, x in licenses.PHRASES.items())}),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b FROM places GROUP BY r),
t(label, tokens, marks) AS (VALUES {_TEMPLATE_ROWS}),
blocks AS (SELECT r, list_distinct(w[i : i + {2 * _STRIDE - 1}]) AS b FROM (SELECT r, w, unnest(range(1, len(w) + 1, {_STRIDE})) AS i FROM d)),
m AS (
  SELECT r, label, max(len(list_intersect(b, tokens)) / len(tokens)) AS c FROM blocks, t
  WHERE len(list_intersect(b, tokens)) >= ceil({licenses.THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(b, marks) GROUP BY r, label),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
al AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS s
  FROM (SELECT r, label FROM places UNION SELECT r, label FROM m) GROUP BY r),
sc AS (SELECT r, max(c) AS c FROM (SELECT r, c FROM m UNION ALL SELECT r, 1.0 FROM places) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word,
       base.b::BIGINT AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
       round(coalesce(sc.c, 0), 6) + 0.0 AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)""")
def op7_license_scan(spark, sf_dir):
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    labels = list(licenses.PHRASES.values())
    places = F.concat(*[F.col(f"places.`{x}`") for x in labels])
    own = F.concat(*[F.when(F.size(F.col(f"places.`{x}`")) > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for x in labels])
    added = F.coalesce(F.col("matches.label"), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))

    def joined(x):
        return F.array_join(F.array_sort(F.array_distinct(x)), ",")

    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), joined(own).alias("base_labels"),
        joined(F.concat(own, added)).alias("labels"),
        (F.round(F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best), 6) + F.lit(0.0)).alias("score"))


@register("op1_site_tree")
def op1_site_tree(spark, sf_dir):
    found = sitetree.main_texts(read_table(spark, sf_dir, "pages"))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


@register("op4_katz_backoff")
def op4_katz_backoff(spark, sf_dir):
    found = katz.score(read_table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_LETTERS = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(filteraudit.FILTERS))


@register("op11_filter_audit", f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, bits),
f(name, bit) AS (VALUES {_LETTERS}),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bit
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, bit, unnest(range(1, 6)) AS step FROM o),
q AS (SELECT filter_order, step, bit[step] AS own, list_sum(bit[1 : step]) - bit[step] AS before FROM s)
SELECT part, filter_order, step::INTEGER AS step,
       coalesce(sum(n) FILTER (bits & (own | before::BIGINT) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before::BIGINT = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before::BIGINT <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (bits & own <> 0 AND bits & before::BIGINT = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (bits & own <> 0 AND bits & before::BIGINT = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (bits & own <> 0), 0)::BIGINT AS shapley
FROM c, q GROUP BY part, filter_order, step""")
def op11_filter_audit(spark, sf_dir):
    found = filteraudit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_H = "sha256(concat({}))".format(", ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
#: Unsigned crc32 (reflected, polynomial 0xEDB88320) of the id's decimal text.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@register("op12_merkle", f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, {_H.format(text="text")} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_H.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM d),
tree AS (  -- the last node of a group stays as it is
  SELECT 0 AS level, grp, idx, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, grp, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM tree) WHERE n > 1 GROUP BY level, grp, idx // 8),
last AS (SELECT grp, max(level) AS level FROM tree GROUP BY grp),
subroots AS (SELECT grp, level, digest, row_number() OVER (ORDER BY grp) - 1 AS idx FROM tree JOIN last USING (grp, level)),
top AS (
  SELECT 0 AS level, idx, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, idx // 8),
root AS (SELECT digest AS root FROM top ORDER BY level DESC LIMIT 1),
height AS (SELECT grp, level AS h, idx AS place, digest AS subroot FROM subroots),
nodes AS (  -- one numbering of levels: a group's own, then those over the subroots
  SELECT t.grp, t.level, t.idx, t.digest FROM tree t JOIN height USING (grp) WHERE t.level < h
  UNION ALL
  SELECT grp, h + top.level, top.idx, top.digest FROM top, height),
runs AS (SELECT grp, level, idx // 8 AS up, list(digest ORDER BY idx) AS kids FROM nodes GROUP BY grp, level, idx // 8),
climb AS (
  SELECT r, grp, h, place, 0 AS level, CASE WHEN h = 0 THEN place ELSE idx END AS idx, coalesce(changed, leaf) AS folded, '' AS proof
  FROM leaves JOIN height USING (grp)
  UNION ALL
  SELECT c.r, c.grp, h, place, c.level + 1, CASE WHEN c.level + 1 = h THEN place ELSE c.idx // 8 END,
         sha256(array_to_string(kids[1 : c.idx % 8], '') || folded || array_to_string(kids[c.idx % 8 + 2 :], '')),
         proof || array_to_string(kids[1 : c.idx % 8], '') || array_to_string(kids[c.idx % 8 + 2 :], '')
  FROM climb c JOIN runs ON runs.grp = c.grp AND runs.level = c.level AND runs.up = c.idx // 8
  WHERE len(kids) > 1 OR c.idx >= 8),
ends AS (SELECT r, folded, proof FROM climb QUALIFY level = max(level) OVER (PARTITION BY r))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN height USING (grp) JOIN ends USING (r), root""")
def op12_merkle(spark, sf_dir):
    found = merkle.proofs(merkle.manifest(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@register("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classifier.classify(docs, read_table(spark, sf_dir, "labels"))
    id_ = F.col("row.doc_id")
    return found.select(id_.cast("long").alias("doc_id"), F.coalesce(~classifier.may_train(id_), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))
