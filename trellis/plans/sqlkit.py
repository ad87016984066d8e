"""DuckDB SQL fragments for the oracle statements (text builders only)."""

from __future__ import annotations

PUNCT = r"[!-/:-@\[-`{-~]"


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


def draw_sql(*parts: str) -> str:
    """52 bits of the md5 draw of :func:`trellis.operators.curriculum.draw`."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


def ws_split(x: str) -> str:
    """Python ``str.split()`` (ASCII white space is all the data holds)."""
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_tokens(x: str) -> str:
    """Tokens of the English answer normaliser (articles dropped as tokens)."""
    return (f"list_filter(string_split_regex(regexp_replace(lower({x}), '{PUNCT}', '', 'g'), '\\s+'), "
            f"lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


def f1_table(items: str, key: str, pred_toks: str, ans_toks: str) -> str:
    """CTE text computing ``same, np, ng`` per ``key`` from two token lists of
    the relation ``items`` (multiset overlap by unnest + group by)."""
    return f"""
toks AS (
  SELECT {key} AS k, t, 0 AS s FROM (SELECT {key}, unnest({pred_toks}) AS t FROM {items})
  UNION ALL
  SELECT {key} AS k, t, 1 AS s FROM (SELECT {key}, unnest({ans_toks}) AS t FROM {items})),
cnt AS (SELECT k, t, count(*) FILTER (WHERE s = 0) AS cp, count(*) FILTER (WHERE s = 1) AS cg
        FROM toks GROUP BY k, t),
ov AS (SELECT k, sum(least(cp, cg))::DOUBLE AS same, sum(cp)::DOUBLE AS np, sum(cg)::DOUBLE AS ng
       FROM cnt GROUP BY k)"""


def f1_expr(same="same", np_="np", ng="ng") -> str:
    return (f"CASE WHEN coalesce({same}, 0) = 0 THEN 0.0 ELSE "
            f"2.0 * ({same} / {np_}) * ({same} / {ng}) / (({same} / {np_}) + ({same} / {ng})) END")


# ---- views (DuckDB forms of trellis.sources.views) ----

QA_PAIRS = """
qa_pairs AS (
  SELECT a.conv_id, a.turn, a.role || '>' || b.role AS dataset, b.text AS pred,
         [a.text] AS answers, (length(a.text) + length(b.text))::INTEGER AS length
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

DOC_PAIRS = """
doc_pairs AS (
  SELECT d.doc_id, d.lang AS dataset, d.text AS pred,
         list_filter([p.text, n.text], lambda x: x IS NOT NULL) AS answers, d.n_chars AS length
  FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1
                   LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)"""

WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"

RESPONSES = f"""
rw AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
responses AS (
  SELECT doc_id, text AS context, array_to_string(w[1:3], ' ') AS ground_truth,
    CASE doc_id % 5
      WHEN 0 THEN 'Answer: ' || array_to_string(w[1:3], ' ')
      WHEN 1 THEN '<think>Looking it up. <retrieval>' || array_to_string(w[2:7], ' ')
                  || '</retrieval></think>' || chr(10) || 'Answer: ' || array_to_string(w[1:3], ' ')
      WHEN 2 THEN '<think><retrieval>' || translate(array_to_string(w[2:7], ' '),
                  'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
                  || '</retrieval> so</think> Answer: ' || coalesce(w[1], '')
      WHEN 3 THEN '  <think><retrieval>' || array_to_string(list_reverse(w[greatest(len(w) - 4, 1):greatest(len(w) - 4, 1) + 4]), ' ')
                  || '</retrieval></think>Answer:' || coalesce(w[-1], '') || chr(10)
      ELSE '<think><retrieval>' || array_to_string(w[2:7], ' ') || '</retrieval> and <retrieval> '
           || array_to_string(w[9:12], ' ' || chr(10) || '  ')
           || ' </retrieval><retrieval>  </retrieval></think> Answer: ' || array_to_string(w[1:3], ' ') || ' Answer: again'
    END AS response
  FROM rw)"""

TAGGED = f"""
tw AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
tagged AS (
  SELECT doc_id, coalesce(w[2], '') AS ground_truth,
    CASE doc_id % 4
      WHEN 0 THEN '<think>' || array_to_string(w[1:5], ' ') || '</think> so \\boxed{{' || coalesce(w[2], '') || '}} done'
      WHEN 1 THEN '<think>' || array_to_string(w[1:5], ' ') || '</think>' || chr(10) || ' <answer> ' || coalesce(w[2], '') || ' </answer>'
      WHEN 2 THEN '<think>x</think><answer>' || coalesce(w[2], '') || chr(10) || 'more</answer>'
      ELSE ' ' || coalesce(w[2], '') || ' '
    END AS response
  FROM tw)"""


def strip(x: str) -> str:
    return py_strip(x)


def spans_sql(resp: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({resp}, '(?s)<retrieval>(.*?)</retrieval>', 1), "
            f"lambda s: {collapse_ws('s')}), lambda s: s <> '')")


def evidence_format_sql(resp: str) -> str:
    s = py_strip(resp)
    return (f"CASE WHEN regexp_full_match({s}, '(?s)<think>.*</think>.*Answer:.*') AND "
            f"regexp_matches(regexp_extract({s}, '(?s)<think>(.*?)</think>', 1), '(?s)<retrieval>.*?</retrieval>') "
            f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


def extract_answer_sql(resp: str) -> str:
    return (f"CASE WHEN strpos({resp}, 'Answer:') > 0 THEN "
            f"{py_strip(f'substr({resp}, strpos({resp}, ' + chr(39) + 'Answer:' + chr(39) + ') + 7)')} ELSE '' END")


def set_f1_sql(ans: str, truth: str) -> str:
    a = f"list_distinct({ws_split(ans)})"
    g = f"list_distinct({ws_split(truth)})"
    c = f"len(list_intersect({a}, {g}))::DOUBLE"
    return (f"CASE WHEN {ans} = '' OR {c} = 0 THEN 0.0 ELSE "
            f"2.0 * ({c} / len({a})) * ({c} / len({g})) / (({c} / len({a})) + ({c} / len({g}))) END")

SEQS = """
seqs AS (
  SELECT user_id, rn // 128 AS piece, (rn % 128)::INTEGER AS pos, ts, event_id, value AS reward,
         event_type = 'purchase' AS is_eos
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))"""

TOKENS = SEQS + """,
tokens AS (
  SELECT user_id, piece, pos, event_id,
         CASE WHEN coalesce(max(is_eos::INTEGER) OVER (PARTITION BY user_id, piece ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0 ELSE 1 END AS mask,
         reward AS score, ln(1 + reward) AS vals, -ln(1 + reward) / 10.0 AS old_lp,
         (-ln(1 + reward) / 10.0) * 1.1 - 0.01 AS ref_lp, (-ln(1 + reward) / 10.0) * 0.9 AS lp,
         ln(1 + reward) * 1.05 + 0.01 AS vpred
  FROM seqs)"""

STEP_LOG = """
step_log AS (
  SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS step,
         avg(value) / 1000.0 AS kl, count(*) AS n, sum(value) / 100.0 AS seconds
  FROM events GROUP BY ALL)"""

GROUPS = """
groups AS (SELECT l_orderkey AS uid, l_linenumber AS sample_id, l_discount AS score, l_extendedprice AS price
           FROM lineitem)"""

ARRAYS = SEQS + """,
arrays AS (
  SELECT seqs.user_id, piece,
         list((CASE e.event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4
               WHEN 'signup' THEN 5 END)::BIGINT ORDER BY pos) AS ids,
         list(reward ORDER BY pos) AS vals
  FROM seqs JOIN events e USING (event_id) GROUP BY seqs.user_id, piece)"""


def zeros(n: str, typ: str = "BIGINT") -> str:
    return f"list_transform(range({n}), lambda x: 0::{typ})"


def eos_mask_sql(ids: str, eos: int) -> str:
    first = f"coalesce(list_position({ids}, {eos}), len({ids}))"
    return f"list_transform({ids}, lambda x, i: CASE WHEN i <= {first} THEN 1 ELSE 0 END)"


def position_ids_sql(mask: str) -> str:
    return f"list_transform({mask}, lambda x, i: greatest(list_sum({mask}[1:i]) - 1, 0)::BIGINT)"
