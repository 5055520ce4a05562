"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op6_ann
from .chat import op3_chat_formatting
from .exact_topk import op9_exact_topk
from .jaccard import op4_jaccard_join
from .mixing import op10_mixing
from .packing import op7_best_fit_packing
from .quality import op2_quality
from .suffix_dedup import op8_suffix_dedup
from .token_records import op1_token_records
from .toxicity import op5_toxicity

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_quality": op2_quality,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_mixing": op10_mixing,
}

OP3_SQL = r"""
WITH src AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, role, text,
         length(regexp_split_to_array(trim(text, ' '), '[ \t\n\v\f\r]+')) AS tokens,
         length(role) + length(text) + 7
           + length(role) - length(replace(replace(replace(role, '\', ''), '[', ''), ']', ''))
           + length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), ']', '')) AS shown
  FROM src),
s AS (SELECT conv_id, tokens AS system_tokens, shown AS system_shown FROM t WHERE place = 0 AND role = 'system'),
u AS (
  SELECT t.*, coalesce(system_tokens, 0) AS y, system_shown, greatest(1, floor((256 - coalesce(system_tokens, 0)) / 2.0)) AS half,
         sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens - coalesce(system_tokens, 0) AS b
  FROM t LEFT JOIN s USING (conv_id)),
v AS (SELECT *, floor(b / half) AS cell, tokens > half AND NOT (place = 0 AND y > 0) AS large FROM u),
w AS (
  SELECT *, CAST(place > CASE WHEN y > 0 THEN 1 ELSE 0 END
              AND (large OR lag(large) OVER o OR cell <> lag(cell) OVER o) AS INT) AS new FROM v
  WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
x AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY place) AS win,
         CASE WHEN new = 1 THEN lag(tokens, 1) OVER o END AS t1, CASE WHEN new = 1 AND place > 1 THEN lag(tokens, 2) OVER o END AS t2,
         lag(shown, 1) OVER o AS s1, lag(shown, 2) OVER o AS s2
  FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
z AS (
  SELECT conv_id, win, 256 - sum(tokens) - max(y) AS room, max(y) AS y, max(system_shown) AS sys, min(place) AS f,
         max(t1) AS t1, max(t2) AS t2, max(s1) FILTER (new = 1) AS s1, max(s2) FILTER (new = 1) AS s2
  FROM x GROUP BY conv_id, win),
again AS (
  SELECT conv_id, count(*) AS windows, sum(CASE WHEN win = 0 THEN 0 ELSE coalesce(sys, 0)
    + CASE WHEN f - 1 >= (sys IS NOT NULL)::INT AND t1 <= room THEN s1
           + CASE WHEN f - 2 >= (sys IS NOT NULL)::INT AND t1 + t2 <= room THEN s2 ELSE 0 END ELSE 0 END END) AS chars
  FROM z GROUP BY conv_id),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(shown) AS chars
  FROM t GROUP BY conv_id)
SELECT c.conv_id, c.n_turns, c.turns_sha256, CAST(length(c.loss) AS BIGINT) AS loss_chars, sha256(c.loss) AS loss_sha256,
       CAST(c.chars + a.chars AS BIGINT) AS formatted_chars, a.windows
FROM conv c JOIN again a USING (conv_id)
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op9_exact_topk": OP9_SQL}
