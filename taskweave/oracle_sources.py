"""DuckDB oracles for the file round-trip queries: what the files must read back as,
computed directly from the parquet tables."""

from __future__ import annotations

from .oracle import FH, FI, FT, SQL, intensity_class_sql, sanitize_sql, with_
from .oracle_interference import FG

# pandas' default missing-value strings.
NA = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
      "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")

SQL["src_csv_header"] = with_(FT) + f"""
SELECT row_id, CASE WHEN tweet IN ({NA}) THEN NULL ELSE tweet END AS tweet, CAST(length(tweet) AS INTEGER) AS label, 'csv' AS fmt FROM ft
UNION ALL
SELECT row_id, CASE WHEN tweet IN ({NA}) THEN NULL ELSE tweet END, CAST(length(tweet) AS INTEGER), 'tsv' FROM ft"""

SQL["src_csv_headerless"] = with_(FH) + "SELECT id, off_label FROM fh_a"

LINES = FT + f""",
lines AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, CAST(doc_id % 2 AS INTEGER) AS emotion_ind,
         CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 50 = 13 THEN '"' WHEN doc_id % 50 = 21 THEN 'NA'
              ELSE regexp_replace(tweet, '[\\r\\n]', ' ', 'g') END AS line
  FROM ft
),
txt AS (SELECT pos, CASE WHEN line IN ({NA}) THEN NULL ELSE line END AS tweet FROM lines),
labs AS (SELECT pos, emotion_ind FROM lines WHERE doc_id < (SELECT max(doc_id) FROM lines))"""

SQL["src_lines_positional"] = with_(LINES) + "SELECT pos, tweet FROM txt"

SQL["join_positional"] = with_(LINES) + """
SELECT t.pos, t.tweet, l.emotion_ind FROM txt t JOIN labs l ON t.pos = l.pos WHERE t.tweet IS NOT NULL"""

SQL["src_similarity_json"] = with_(FG) + """
SELECT pair, grp, row_number() OVER (PARTITION BY pair, grp ORDER BY step) - 1 AS idx,
       round(similarity, 6) AS similarity FROM sims"""

SQL["sink_similarity_json"] = with_(FG) + """
SELECT pair,
  CAST(count(*) FILTER (WHERE grp = 'all_model') AS INTEGER) AS n_all_model,
  round(coalesce(sum(similarity) FILTER (WHERE grp = 'all_model' AND NOT isnan(similarity)), 0), 6) AS sum_all_model,
  CAST(count(*) FILTER (WHERE grp = 'encoder') AS INTEGER) AS n_encoder,
  round(coalesce(sum(similarity) FILTER (WHERE grp = 'encoder' AND NOT isnan(similarity)), 0), 6) AS sum_encoder,
  CAST(count(*) FILTER (WHERE grp = 'fc_layer') AS INTEGER) AS n_fc_layer,
  round(coalesce(sum(similarity) FILTER (WHERE grp = 'fc_layer' AND NOT isnan(similarity)), 0), 6) AS sum_fc_layer,
  CAST(count(*) FILTER (WHERE isnan(similarity)) AS INTEGER) AS n_bare_nan, 0 AS n_quoted_nan
FROM sims GROUP BY pair"""

SQL["src_multi_file_provenance"] = with_(FI) + f"""
SELECT id, 'tweet ' || id AS tweet, dimension AS task,
       (['train', 'dev', 'test-gold'])[CAST(CAST(id AS BIGINT) % 3 AS INTEGER) + 1] AS split,
       CASE WHEN dimension IN ({NA}) THEN NULL ELSE dimension END AS emotion,
       CASE WHEN intensity IN ({NA}) THEN NULL ELSE intensity END AS intensity
FROM fi_base"""

SQL["sink_wide_csv"] = SQL["grad_cosine_per_param"]

SQL["sink_metric_scalars"] = """
WITH fs AS (
  SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value
  FROM events
),
fm AS (
  SELECT 'fs' AS run, series AS task, idx // 4 AS epoch,
         (['train', 'train', 'val', 'val'])[CAST(idx % 4 AS INTEGER) + 1] AS split,
         (['accuracy', 'loss', 'accuracy', 'loss'])[CAST(idx % 4 AS INTEGER) + 1] AS name,
         CASE WHEN idx % 4 IN (0, 2) THEN value % 1 ELSE value END AS value
  FROM fs
)
SELECT run, CASE WHEN split = 'train' THEN 'Training' ELSE 'Validation' END || ' ' || name || '_' || task AS tag,
       CAST(epoch + 1 AS BIGINT) AS step, round(value, 6) AS value
FROM fm"""

SQL["corpus_build_sources"] = with_(FT, FI) + f"""
, one AS (
  SELECT t || ':' || doc_id AS row_id, tweet, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS emotion_ind, t AS task,
         doc_id % 5 = 0 AS is_test
  FROM ft, (VALUES ('sarcasm'), ('offensive')) f(t)
), two AS (
  SELECT *, CASE WHEN is_test THEN 'test'
                 WHEN row_number() OVER (PARTITION BY task, is_test ORDER BY md5('3:split:' || row_id), row_id)
                      <= ceil(count(*) OVER (PARTITION BY task, is_test) * CAST(0.3 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM one
), three AS (
  SELECT (['train', 'val', 'test'])[CAST(doc_id % 3 AS INTEGER) + 1] AS split, doc_id,
         row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS pos, regexp_replace(tweet, '[\\r\\n]', ' ', 'g') AS tweet,
         CAST(doc_id % 2 AS INTEGER) AS emotion_ind
  FROM ft
), rows AS (
  SELECT row_id, tweet, emotion_ind, CASE WHEN emotion_ind = 0 THEN 'non_' || task ELSE task END AS emotion, task, split FROM two
  UNION ALL
  SELECT 'hate:' || split || ':' || pos, tweet, emotion_ind, CASE WHEN emotion_ind = 0 THEN 'non_hate' ELSE 'hate' END, 'hate', split FROM three
  UNION ALL
  SELECT 'ei:' || id, 'RT tweet ' || id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 0 ELSE 1 END, {intensity_class_sql('intensity')},
         dimension, (['train', 'val', 'test'])[CAST(CAST(id AS BIGINT) % 3 AS INTEGER) + 1]
  FROM fi_base
)
SELECT row_id, {sanitize_sql('tweet')} AS tweet, emotion, emotion_ind, task, split FROM rows
WHERE emotion IS NOT NULL AND tweet NOT IN ({NA})"""
