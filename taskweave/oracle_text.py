"""DuckDB oracles for T9 (vocabulary and fixed-length encoding)."""

from __future__ import annotations

from .oracle import FT, SQL, WS, lit, sanitize_sql, with_

TOK = FT + f""",
tok AS (SELECT row_id, list_filter(regexp_split_to_array({sanitize_sql('tweet')}, {lit(WS + '+')}), lambda t: t <> '') AS t FROM ft),
vocab AS (
  SELECT token, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS BIGINT) AS id
  FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token
)"""

SQL["txt_vocab"] = with_(TOK) + "SELECT token, count, id FROM vocab"

SQL["txt_encode_fixed"] = with_(TOK) + """,
el AS (SELECT row_id, unnest(t[1:178]) AS token, unnest(range(0, len(t[1:178]))) AS pos FROM tok),
ids AS (
  SELECT el.row_id, list(v.id ORDER BY el.pos) AS ids FROM el JOIN vocab v ON el.token = v.token GROUP BY el.row_id
),
enc AS (
  SELECT tok.row_id, CAST(len(tok.t) AS INTEGER) AS n_tokens, coalesce(ids.ids, CAST([] AS BIGINT[])) AS ids
  FROM tok LEFT JOIN ids ON tok.row_id = ids.row_id
)
SELECT row_id, n_tokens,
       md5(array_to_string(list_concat([1], ids, [2], list_resize(CAST([] AS BIGINT[]), 178 - len(ids), 0)), ',')) AS ids_md5,
       CAST(len(ids) + 2 AS INTEGER) AS mask_sum, 180 AS length
FROM enc"""
