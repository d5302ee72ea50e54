"""DuckDB oracles for the interference, window and report queries.

Gradients are handled element by element here (one row per vector component),
a different route from the Spark implementation's chunked arrays.
"""

from __future__ import annotations

from .oracle import FV, SQL, with_

FG = FV + """,
fg_src AS (SELECT CAST(vec_id // 20 AS INTEGER) AS step, vec_id, task, emotion_ind, x FROM fv),
fg_el0 AS (
  SELECT step, task, 'encoder.P' AS param, i, sum((2 * emotion_ind - 1) * v) AS v
  FROM (SELECT step, task, emotion_ind, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM fg_src) GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT step, task, 'fc_layer.weight', i, sum(v)
  FROM (SELECT step, task, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM fg_src) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT step, task, 'fc_layer.bias', 0, CAST(count(*) AS DOUBLE) FROM fg_src GROUP BY 1, 2
  UNION ALL SELECT step, task, 'fc_layer.bias', 1, CAST(sum(emotion_ind) AS DOUBLE) FROM fg_src GROUP BY 1, 2
),
fg_el AS (
  SELECT * FROM fg_el0
  UNION ALL SELECT DISTINCT 0, 'tz', param, i, 0.0 FROM fg_el0 WHERE step = 0
),
fg_g AS (
  SELECT step, task, param, i, v, CASE WHEN contains(param, 'fc_layer') THEN 'fc_layer' ELSE 'encoder' END AS grp
  FROM fg_el
  UNION ALL SELECT step, task, param, i, v, 'all_model' FROM fg_el
),
norms AS (SELECT step, task, grp, sum(v * v) AS nn FROM fg_g GROUP BY 1, 2, 3),
tasks AS (SELECT task, CAST(row_number() OVER (ORDER BY task) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT task FROM fg_el)),
pairs AS (
  SELECT a.ord AS ord_1, a.task AS task_1, b.ord AS ord_2, b.task AS task_2, a.task || '-' || b.task AS pair
  FROM tasks a JOIN tasks b ON a.ord < b.ord
),
dots AS (
  SELECT a.step, p.pair, p.task_1, p.task_2, a.grp, sum(a.v * b.v) AS d
  FROM fg_g a JOIN pairs p ON a.task = p.task_1
  JOIN fg_g b ON b.task = p.task_2 AND b.step = a.step AND b.grp = a.grp AND b.param = a.param AND b.i = a.i
  GROUP BY 1, 2, 3, 4, 5
),
sims AS (
  SELECT d.step, d.pair, d.task_1, d.task_2, d.grp,
         CASE WHEN n1.nn = 0 OR n2.nn = 0 THEN CAST('NaN' AS DOUBLE) ELSE d.d / (sqrt(n1.nn) * sqrt(n2.nn)) END AS similarity
  FROM dots d JOIN norms n1 ON n1.step = d.step AND n1.task = d.task_1 AND n1.grp = d.grp
              JOIN norms n2 ON n2.step = d.step AND n2.task = d.task_2 AND n2.grp = d.grp
)"""

FS = """
fs AS (
  SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value
  FROM events
)"""

SQL["join_task_pairs"] = with_(FG) + "SELECT ord_1, task_1, ord_2, task_2, pair FROM pairs"

SQL["grad_concat_groups"] = with_(FG) + """,
pr AS (
  SELECT step, task, grp, param, count(*) AS length, sum(v * v) AS sq
  FROM fg_g GROUP BY 1, 2, 3, 4
)
SELECT step, task, grp, param, 0 AS chunk,
       CAST(coalesce(sum(length) OVER (PARTITION BY step, task, grp ORDER BY
            CASE param WHEN 'encoder.P' THEN 0 WHEN 'fc_layer.weight' THEN 1 ELSE 2 END
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
       CAST(length AS INTEGER) AS length, round(sq, 6) AS sq_norm
FROM pr"""

SQL["grad_cosine_groups"] = with_(FG) + """
SELECT step, pair, task_1, task_2, grp, round(similarity, 6) AS similarity FROM sims"""

SQL["filter_pair_prefix"] = with_(FG) + """
SELECT step, pair, grp, round(similarity, 6) AS similarity FROM sims WHERE contains(pair, 't0-')"""

SQL["grad_cosine_per_param"] = with_(FV + """,
ph_src AS (
  SELECT CAST(vec_id // 80 AS INTEGER) AS step, task, emotion_ind, x,
         CASE WHEN vec_id % 2 = 0 THEN 'inner' ELSE 'outer' END AS phase,
         CASE WHEN (vec_id // 2) % 2 = 0 THEN 'episode' ELSE 'ref' END AS kind
  FROM fv
),
ph_el AS (
  SELECT step, task, phase, kind, 'encoder.P' AS param, i, sum((2 * emotion_ind - 1) * v) AS v
  FROM (SELECT *, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM ph_src) GROUP BY 1, 2, 3, 4, 5, 6
  UNION ALL
  SELECT step, task, phase, kind, 'fc_layer.weight', i, sum(v)
  FROM (SELECT *, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM ph_src) GROUP BY 1, 2, 3, 4, 5, 6
  UNION ALL SELECT step, task, phase, kind, 'fc_layer.bias', 0, CAST(count(*) AS DOUBLE) FROM ph_src GROUP BY 1, 2, 3, 4
  UNION ALL SELECT step, task, phase, kind, 'fc_layer.bias', 1, CAST(sum(emotion_ind) AS DOUBLE) FROM ph_src GROUP BY 1, 2, 3, 4
),
combos AS (
  SELECT 't0_t1' AS pair, a.step, a.phase, a.param, a.v AS va, b.v AS vb FROM ph_el a JOIN ph_el b
    ON a.step = b.step AND a.phase = b.phase AND a.param = b.param AND a.i = b.i
  WHERE a.task = 't0' AND a.kind = 'episode' AND b.task = 't1' AND b.kind = 'episode'
  UNION ALL
  SELECT 't0_t0', a.step, a.phase, a.param, a.v, b.v FROM ph_el a JOIN ph_el b
    ON a.step = b.step AND a.phase = b.phase AND a.param = b.param AND a.i = b.i
  WHERE a.task = 't0' AND a.kind = 'episode' AND b.task = 't0' AND b.kind = 'ref'
  UNION ALL
  SELECT 't1_t1', a.step, a.phase, a.param, a.v, b.v FROM ph_el a JOIN ph_el b
    ON a.step = b.step AND a.phase = b.phase AND a.param = b.param AND a.i = b.i
  WHERE a.task = 't1' AND a.kind = 'episode' AND b.task = 't1' AND b.kind = 'ref'
)""") + """
SELECT step, phase, pair, param,
       round(CASE WHEN sum(va * va) = 0 OR sum(vb * vb) = 0 THEN CAST('NaN' AS DOUBLE)
                  ELSE sum(va * vb) / (sqrt(sum(va * va)) * sqrt(sum(vb * vb))) END, 6) AS similarity
FROM combos GROUP BY step, phase, pair, param"""

SQL["agg_grad_accumulate"] = with_(FG) + """,
nt AS (SELECT step, count(DISTINCT task) AS nt FROM fg_el GROUP BY step)
SELECT 'sum' AS mode, step, CAST(NULL AS VARCHAR) AS owner, param, CAST(i AS INTEGER) AS i, round(sum(v), 6) AS g
FROM fg_el GROUP BY step, param, i
UNION ALL
SELECT 'mean_shared_only', e.step, NULL, e.param, CAST(e.i AS INTEGER), round(sum(e.v) / min(nt.nt), 6)
FROM fg_el e JOIN nt ON e.step = nt.step WHERE NOT contains(e.param, 'fc_layer') GROUP BY e.step, e.param, e.i
UNION ALL
SELECT 'shared_sum_head_own', step, NULL, param, CAST(i AS INTEGER), round(sum(v), 6)
FROM fg_el WHERE NOT contains(param, 'fc_layer') GROUP BY step, param, i
UNION ALL
SELECT 'shared_sum_head_own', step, task, param, CAST(i AS INTEGER), round(v, 6)
FROM fg_el WHERE contains(param, 'fc_layer')"""

SQL["grad_param_update"] = with_(FG) + """,
t0 AS (SELECT param, i, avg(v) AS t0 FROM fg_el GROUP BY 1, 2),
u AS (SELECT step, param, i, sum(v) AS u FROM fg_el GROUP BY 1, 2, 3)
SELECT u.step, u.param, CAST(u.i AS INTEGER) AS i,
       round(t0.t0 - 0.001 * sum(u.u) OVER (PARTITION BY u.param, u.i ORDER BY u.step
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
FROM u JOIN t0 ON u.param = t0.param AND u.i = t0.i"""

SQL["grad_clip_global_norm"] = with_(FG) + """,
tot AS (SELECT step, task, sqrt(sum(v * v)) AS total_norm FROM fg_el GROUP BY 1, 2)
SELECT e.step, e.task, e.param, round(t.total_norm, 6) AS total_norm,
       round(least(1.0, 1.0 / (t.total_norm + 1e-6)), 6) AS coef, CAST(e.i AS INTEGER) AS i,
       round(e.v * least(1.0, 1.0 / (t.total_norm + 1e-6)), 6) AS g
FROM fg_el e JOIN tot t ON e.step = t.step AND e.task = t.task"""

SQL["filter_every_nth"] = with_(FS) + "SELECT series, idx, value FROM fs WHERE idx % 10 = 0"

SQL["win_rolling_mean"] = with_(FS) + """
SELECT series, idx, value,
       round(CASE WHEN count(CASE WHEN NOT isnan(value) THEN value END) OVER w = 20
                  THEN avg(CASE WHEN NOT isnan(value) THEN value END) OVER w END, 6) AS rolling
FROM fs WINDOW w AS (PARTITION BY series ORDER BY idx RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)"""

SQL["win_step_axis"] = with_(FS) + """
SELECT series, idx // 10 AS idx, CAST((idx // 10) * 10 AS BIGINT) AS x, value FROM fs WHERE idx % 10 = 0"""

ACC = FS + """,
acc AS (
  SELECT series, idx, CASE WHEN idx % 7 = 3 OR value % 1 > 0.98 THEN NULL ELSE value % 1 END AS value FROM fs  -- NULL stands for NaN
)"""

SQL["win_running_best"] = with_(ACC) + """
SELECT series, idx, round(value, 6) AS value, round(prev_best, 6) AS prev_best FROM (
  SELECT *, greatest(0.0, coalesce(max(value) OVER (PARTITION BY series ORDER BY idx
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS prev_best
  FROM acc)
WHERE value > prev_best"""

SQL["topk_best_epoch"] = with_(ACC) + """
SELECT series, CAST(CASE WHEN max(value) > 0 THEN min(idx) FILTER (WHERE value = mx) ELSE 0 END AS BIGINT) AS best_epoch,
       round(CASE WHEN max(value) > 0 THEN max(value) ELSE 0.0 END, 6) AS best_value
FROM (SELECT *, max(value) OVER (PARTITION BY series) AS mx FROM acc) GROUP BY series"""

SQL["win_epoch_history"] = with_(FS) + """,
fm AS (
  SELECT 'fs' AS run, series AS task, idx // 4 AS epoch,
         (['train', 'train', 'val', 'val'])[CAST(idx % 4 AS INTEGER) + 1] AS split,
         (['accuracy', 'loss', 'accuracy', 'loss'])[CAST(idx % 4 AS INTEGER) + 1] AS name,
         CASE WHEN idx % 4 IN (0, 2) THEN value % 1 ELSE value END AS value
  FROM fs
)
SELECT run, task, epoch,
       round(max(CASE WHEN split = 'train' AND name = 'accuracy' THEN value END), 6) AS train_accuracy,
       round(max(CASE WHEN split = 'train' AND name = 'loss' THEN value END), 6) AS train_loss,
       round(max(CASE WHEN split = 'val' AND name = 'accuracy' THEN value END), 6) AS val_accuracy,
       round(max(CASE WHEN split = 'val' AND name = 'loss' THEN value END), 6) AS val_loss
FROM fm GROUP BY run, task, epoch"""

SQL["job_interference_report"] = with_(FG) + """,
ser AS (
  SELECT pair, grp, step AS idx, similarity,
         CASE WHEN count(CASE WHEN NOT isnan(similarity) THEN 1 END) OVER w = 20
              THEN avg(CASE WHEN NOT isnan(similarity) THEN similarity END) OVER w END AS rolling,
         max(step) OVER (PARTITION BY pair, grp) AS last_idx
  FROM sims WINDOW w AS (PARTITION BY pair, grp ORDER BY step RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)
)
SELECT pair, grp, count(*) AS n_points,
       round(avg(CASE WHEN NOT isnan(similarity) THEN similarity END), 6) AS mean_similarity,
       round(avg(CASE WHEN isnan(similarity) THEN NULL WHEN similarity < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share,
       count(rolling) AS n_rolling,
       round(max(CASE WHEN idx = last_idx THEN rolling END), 6) AS last_rolling
FROM ser GROUP BY pair, grp"""

SQL["win_epoch_history_long"] = with_(FS) + """
SELECT 'fs' AS run, series AS task, idx // 4 AS epoch,
       (['train', 'train', 'val', 'val'])[CAST(idx % 4 AS INTEGER) + 1] AS split,
       (['accuracy', 'loss', 'accuracy', 'loss'])[CAST(idx % 4 AS INTEGER) + 1] AS name,
       round(CASE WHEN idx % 4 IN (0, 2) THEN value % 1 ELSE value END, 6) AS value
FROM fs"""

SQL["best_macro_epoch"] = with_(FS) + """,
macro AS (
  SELECT idx // 4 AS epoch, avg(value % 1) AS value FROM fs WHERE idx % 4 = 2 GROUP BY 1
),
seen AS (
  SELECT *, coalesce(max(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM macro
)
SELECT 'fs' AS run, CAST(coalesce(max(CASE WHEN value = mx THEN -epoch END), 0) * -1 AS BIGINT) AS best_epoch,
       round(max(value), 6) AS best_value, count(*) FILTER (WHERE value > prev AND value > 0) AS n_improvements
FROM (SELECT *, max(value) OVER () AS mx FROM seen)"""

SQL["best_task_epoch"] = with_(FS) + """,
acc AS (SELECT series AS task, idx // 4 AS epoch, value % 1 AS value FROM fs WHERE idx % 4 = 2),
seen AS (
  SELECT *, coalesce(max(value) OVER (PARTITION BY task ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
         max(value) OVER (PARTITION BY task) AS mx FROM acc
)
SELECT 'fs' AS run, task, CAST(coalesce(min(CASE WHEN value = mx AND mx > 0 THEN epoch END), 0) AS BIGINT) AS best_epoch, round(max(value), 6) AS best_value,
       count(*) FILTER (WHERE value > prev AND value > 0) AS n_improvements
FROM seen GROUP BY task"""

SQL["similarity_series"] = with_(FG) + """,
own AS (
  SELECT pair, grp, row_number() OVER (PARTITION BY pair, grp ORDER BY step) - 1 AS idx,
         CASE WHEN isnan(similarity) THEN NULL ELSE similarity END AS number, similarity
  FROM sims WHERE contains(pair, 't0-')
)
SELECT pair, grp, idx, CAST(idx * 10 AS BIGINT) AS x, round(similarity, 6) AS similarity,
       round(CASE WHEN count(number) OVER w = 5 THEN avg(number) OVER w END, 6) AS rolling
FROM own WINDOW w AS (PARTITION BY pair, grp ORDER BY idx RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"""
