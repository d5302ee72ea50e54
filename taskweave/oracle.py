"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code: plain windows and GROUP BYs over the
pre-registered parquet views, fixtures re-derived as CTEs.  Regex patterns are
repeated here as literal text on purpose (the oracle must not import the
implementation).
"""

from __future__ import annotations

# ---- fixed values: patterns and fixture constants -----------------------------------
WS = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NWS = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
# Emoji sequences of the fixture and characters that look like them but are none, as literal text.
EMOJI_CASES = ("\U0001F600", "\u2122", "\u00a9", "\u203c\ufe0f", "\u2194", "\u25b6\ufe0f", "\u3030", "1\ufe0f\u20e3", "\U0001F1E9\U0001F1EA",
               "\U0001F468\u200d\U0001F469\u200d\U0001F467", "\U0001F44D\U0001F3FD", "\u2764\ufe0f",
               "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F")
NO_EMOJI_CASES = ("\u2713", "\u2610", "\u2776", "1", "#", "*", "\u00e9", "\u4e2d")
EMOTICON = r"[<>]?[:;=8][-o*']?[)\](\[dDpP/:}{@|\\]|[)\](\[dDpP/:}{@|\\][-o*']?[:;=8][<>]?"
MENTION = r"@[\p{L}\p{N}_]+"
TCO = r"http//t[^\n]co/" + NWS + "+"
TCO_I = r"https?://t\.co/" + NWS + "+"
RT = "RT" + WS + "+"
RT_I = "^RT" + WS + "+"
URL = r"https?://S+"
URL_I = r"https?://" + NWS + "+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, '', 'g')"


def strip_cases(e: str) -> str:
    """Deletes the emoji sequences of the fixture one by one, longer ones first; the other cases stay."""
    for case in sorted(EMOJI_CASES, key=len, reverse=True):
        e = f"replace({e}, {lit(case)}, '')"
    return e


def sanitize_sql(e: str) -> str:
    e = strip_cases(e)
    e = rx(e, MENTION)
    e = f"replace({e}, '#', '')"
    e = rx(e, TCO)
    e = rx(e, RT)
    return rx(e, URL)


def sanitize_intended_sql(e: str) -> str:
    e = strip_cases(e)
    e = rx(e, TCO_I)
    e = rx(e, URL_I)
    e = rx(e, EMOTICON)
    e = rx(e, MENTION)
    e = f"replace({e}, '#', '')"
    return rx(e, RT_I)


# ---- fixture CTEs ------------------------------------------------------------------------
FD_RAW = """
fd_u AS (
  SELECT d.doc_id, d.text, 'quality' AS task, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT d.doc_id, d.text, 'toxic' AS task, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
fd_raw AS (
  SELECT task || ':' || CAST(doc_id AS VARCHAR) AS row_id, doc_id,
         'RT @usr_' || CAST(doc_id AS VARCHAR) || ' ART ' || text || ' #tag https://Sabc http//t.co/zz :-) \U0001F600' AS tweet,
         CAST(label AS INTEGER) AS label,
         CASE WHEN label = 0 THEN 0 ELSE 1 END AS emotion_ind,
         CASE WHEN label = 0 OR label IS NULL THEN 'non_' || task ELSE task END AS emotion,
         task
  FROM fd_u
)"""

FT = f"""
ft AS (
  SELECT CAST(doc_id AS VARCHAR) AS row_id, doc_id,
         'RT @usr_' || CAST(doc_id AS VARCHAR) || ' ART ' || text || ' #tag https://Sabc http//t.co/zz :-) \U0001F600'
         || ' ' || ([{', '.join(lit(x) for x in EMOJI_CASES + NO_EMOJI_CASES)}])[CAST(doc_id % {len(EMOJI_CASES + NO_EMOJI_CASES)} AS INTEGER) + 1] AS tweet
  FROM documents
)"""

FD_SPLIT = FD_RAW + """,
fd_split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY md5('3:split:' || row_id), row_id)
                      <= ceil(count(*) OVER (PARTITION BY task) * CAST(0.3 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM fd_raw
)"""

CORPUS = FD_SPLIT + f""",
corpus AS (
  SELECT row_id, {sanitize_sql('tweet')} AS tweet, emotion, emotion_ind, task, split FROM fd_split
)"""

FV = """
fv AS (
  SELECT CAST(vec_id AS VARCHAR) AS row_id, vec_id,
         't' || CAST(CAST(floor(label / 2) AS BIGINT) AS VARCHAR) AS task,
         CAST(label % 2 AS INTEGER) AS emotion_ind,
         CASE WHEN label % 2 = 1 THEN 't' || CAST(CAST(floor(label / 2) AS BIGINT) AS VARCHAR)
              ELSE 'non_t' || CAST(CAST(floor(label / 2) AS BIGINT) AS VARCHAR) END AS emotion,
         CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings
)"""

FV_SPLIT = FV + """,
fv_split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY md5('3:split:' || row_id), row_id)
                      <= ceil(count(*) OVER (PARTITION BY task) * CAST(0.3 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM fv
)"""

FI = """
fi_base AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         (['sadness', 'joy', 'anger', 'fear', 'calm'])[CAST(event_id % 5 AS INTEGER) + 1] AS dimension,
         CAST(event_id % 4 AS VARCHAR) || ': amount of '
           || (['sadness', 'joy', 'anger', 'fear', 'calm'])[CAST(event_id % 5 AS INTEGER) + 1] AS intensity
  FROM events
),
fi AS (
  SELECT * FROM fi_base
  UNION ALL SELECT 'edge0', 'joy', '10: joy'
  UNION ALL SELECT 'edge1', 'joy', ': fear'
  UNION ALL SELECT 'edge2', 'joy', '2: a: b'
  UNION ALL SELECT 'edge3', 'joy', NULL
)"""

FH = """
fh_a AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'OFF' ELSE 'NOT' END AS off_label FROM labels),
fh_b AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'TIN' ELSE 'UNT' END AS off_label FROM labels WHERE toxic = 1
  UNION ALL SELECT min(doc_id), 'TIN' FROM labels WHERE toxic = 0 HAVING min(doc_id) IS NOT NULL
),
fh_c AS (
  SELECT doc_id AS id, (['IND', 'GRP', 'OTH'])[CAST(doc_id % 3 AS INTEGER) + 1] AS off_label
  FROM labels WHERE toxic = 1 AND quality = 1
  UNION ALL SELECT min(doc_id), 'IND' FROM labels WHERE toxic = 1 AND quality = 0 HAVING min(doc_id) IS NOT NULL
)"""


def intensity_class_sql(c: str) -> str:
    def pick(prefix):
        return ("CASE " + " ".join(f"WHEN contains({c}, '{e}') THEN '{prefix}{e}'"
                                   for e in ("sadness", "joy", "anger", "fear")) + " END")
    return (f"CASE WHEN contains({c}, '0') THEN {pick('non_')} "
            f"WHEN contains({c}, '1') OR contains({c}, '2') OR contains({c}, '3') THEN {pick('')} END")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["corpus_build"] = with_(CORPUS) + "SELECT row_id, tweet, emotion, emotion_ind, task, split FROM corpus"

SQL["corpus_summary"] = with_(CORPUS) + """
SELECT split, task, emotion, count(*) AS n_rows, round(avg(length(tweet)), 6) AS avg_len,
       CAST(sum(length(tweet)) AS BIGINT) AS total_len
FROM corpus GROUP BY split, task, emotion"""

SQL["norm_binary_label"] = with_(FD_RAW, FH) + """
SELECT row_id AS id, CAST(label AS VARCHAR) AS raw, CASE WHEN label = 0 THEN 0 ELSE 1 END AS emotion_ind,
       'numeric' AS kind FROM fd_raw
UNION ALL
SELECT CAST(id AS VARCHAR), off_label, CASE WHEN off_label IN ('NOT', 'not_sarcastic') THEN 0 ELSE 1 END, 'string'
FROM (SELECT * FROM fh_a UNION ALL SELECT * FROM fh_b UNION ALL SELECT * FROM fh_c)"""

SQL["norm_class_name"] = with_(FV) + """
SELECT row_id, task, emotion_ind, CASE WHEN emotion_ind = 1 THEN task ELSE 'non_' || task END AS emotion FROM fv"""

SQL["norm_intensity_class"] = with_(FI) + f"""
SELECT id, intensity, {intensity_class_sql('intensity')} AS emotion FROM fi"""

SQL["norm_intensity_split"] = with_(FI) + """
SELECT id, intensity, string_split(intensity, ':')[1] AS ind_text,
       TRY_CAST(string_split(intensity, ':')[1] AS INTEGER) AS emotion_ind,
       CASE WHEN len(string_split(intensity, ':')) >= 2 THEN string_split(intensity, ':')[2] END AS emo_desc,
       CAST(len(string_split(intensity, ':')) AS INTEGER) AS n_parts,
       len(string_split(intensity, ':')) <> 2 AS bad_shape
FROM fi"""

SQL["norm_ordinal_mode"] = with_(FI) + """
SELECT id, TRY_CAST(string_split(intensity, ':')[1] AS INTEGER) AS ordinal,
       CASE WHEN TRY_CAST(string_split(intensity, ':')[1] AS INTEGER) = 0 THEN 0 ELSE 1 END AS binary
FROM fi"""

SQL["norm_rename_constant"] = with_(FI) + f"""
SELECT id, intensity AS tweet, dimension AS task, {intensity_class_sql('intensity')} AS emotion, 'semeval' AS source
FROM fi"""

SQL["norm_dropna_any"] = with_(FI) + f"""
SELECT * FROM (
  SELECT id, {intensity_class_sql('intensity')} AS emotion,
         TRY_CAST(string_split(intensity, ':')[1] AS INTEGER) AS emotion_ind FROM fi)
WHERE id IS NOT NULL AND emotion IS NOT NULL AND emotion_ind IS NOT NULL"""

SQL["norm_canonical_projection"] = with_(FD_RAW) + "SELECT tweet, emotion, emotion_ind, task FROM fd_raw"

_TXT = {
    "txt_strip_emoji": strip_cases,
    "txt_strip_emoticon": lambda e: rx(e, EMOTICON),
    "txt_strip_mention": lambda e: rx(e, MENTION),
    "txt_strip_hash": lambda e: f"replace({e}, '#', '')",
    "txt_strip_tco": lambda e: rx(e, TCO),
    "txt_strip_rt": lambda e: rx(e, RT),
    "txt_strip_url": lambda e: rx(e, URL),
    "txt_sanitize": sanitize_sql,
    "txt_sanitize_intended": sanitize_intended_sql,
}
for _k, _f in _TXT.items():
    SQL[_k] = with_(FT) + f"SELECT row_id, {_f('tweet')} AS tweet FROM ft"

SQL["join_inner_id"] = """
SELECT d.doc_id AS id, CAST(length(d.text) AS INTEGER) AS tweet_len, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

SQL["join_label_hierarchy"] = with_(FH) + """
SELECT a.id, a.off_label AS label_a, b.off_label AS label_b, c.off_label AS label_c,
       coalesce((a.off_label = 'NOT' AND b.off_label IS NULL AND c.off_label IS NULL)
             OR (a.off_label = 'OFF' AND b.off_label = 'UNT' AND c.off_label IS NULL)
             OR (a.off_label = 'OFF' AND b.off_label = 'TIN' AND c.off_label IN ('IND', 'GRP', 'OTH')), false) AS valid
FROM fh_a a LEFT JOIN fh_b b ON a.id = b.id LEFT JOIN fh_c c ON a.id = c.id"""

SQL["join_hierarchy_violations"] = with_(FH) + """
SELECT id, 'b' AS level, off_label AS label FROM fh_b WHERE id NOT IN (SELECT id FROM fh_a WHERE off_label = 'OFF')
UNION ALL
SELECT id, 'c', off_label FROM fh_c
WHERE id NOT IN (SELECT b.id FROM fh_b b JOIN fh_a a ON a.id = b.id WHERE b.off_label = 'TIN' AND a.off_label = 'OFF')"""

SQL["union_all_tasks"] = with_(FD_RAW) + "SELECT row_id, tweet, emotion, emotion_ind, task FROM fd_raw"

SQL["filter_task"] = with_(FD_SPLIT) + "SELECT row_id, task, emotion_ind, split FROM fd_split WHERE task = 'toxic'"

SQL["filter_task_list"] = with_(FV) + """
SELECT fv.row_id, fv.task, t.ord, fv.emotion_ind
FROM fv JOIN (VALUES ('t3', 0), ('t0', 1), ('t4', 2)) t(task, ord) ON fv.task = t.task"""

SQL["split_holdout"] = with_(FD_SPLIT) + "SELECT row_id, task, split FROM fd_split"

SQL["balance_min_downsample"] = with_(FV_SPLIT) + """,
sz AS (SELECT split, task, count(*) AS n FROM fv_split GROUP BY split, task),
m AS (SELECT split, min(n) AS m FROM sz GROUP BY split),
r AS (SELECT row_id, task, split,
             row_number() OVER (PARTITION BY split, task ORDER BY md5('3:balance:' || row_id), row_id) AS rk
      FROM fv_split)
SELECT r.row_id, r.task, r.split FROM r JOIN m ON r.split = m.split WHERE r.rk <= m.m"""

SQL["batch_shuffled"] = with_(FV) + """,
r AS (SELECT row_id, task, row_number() OVER (PARTITION BY task ORDER BY md5('3:1:0:' || row_id), row_id) AS rk FROM fv)
SELECT row_id, task, CAST((rk - 1) // 32 AS BIGINT) AS batch, CAST((rk - 1) % 32 AS INTEGER) AS pos FROM r"""

EPISODES = FV + """,
cls AS (SELECT task, emotion_ind, count(*) AS n, CAST(ceil(count(*) / 10.0) AS BIGINT) AS nb FROM fv GROUP BY 1, 2),
ll AS (SELECT min(nb) AS l FROM cls),
draws AS (
  SELECT c.task, c.emotion_ind, g, g // c.nb AS pass, g % c.nb AS batch,
         CAST(g // ll.l AS INTEGER) AS epoch, CAST(g % ll.l AS INTEGER) AS episode
  FROM cls c CROSS JOIN ll CROSS JOIN LATERAL (SELECT unnest(range(0, ll.l * 2)) AS g)
),
passes AS (SELECT task, emotion_ind, max(pass) AS mp FROM draws GROUP BY 1, 2),
expanded AS (
  SELECT fv.row_id, fv.task, fv.emotion_ind, p.pass
  FROM fv JOIN passes ps ON fv.task = ps.task AND fv.emotion_ind = ps.emotion_ind
  CROSS JOIN LATERAL (SELECT unnest(range(0, ps.mp + 1)) AS pass) p
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task, emotion_ind, pass
                               ORDER BY md5('3:' || CAST(pass AS VARCHAR) || ':' || row_id), row_id) AS rk
  FROM expanded
),
episodes AS (
  SELECT r.row_id, r.task, r.emotion_ind, CAST((r.rk - 1) % 10 AS INTEGER) AS pos, d.epoch, d.episode
  FROM ranked r JOIN draws d ON r.task = d.task AND r.emotion_ind = d.emotion_ind AND r.pass = d.pass
                             AND (r.rk - 1) // 10 = d.batch
)"""

SQL["episode_sampler"] = with_(EPISODES) + "SELECT row_id, task, emotion_ind, pos, epoch, episode FROM episodes"

SQL["episode_support_query"] = with_(EPISODES) + """
SELECT row_id, task, emotion_ind, pos, epoch, episode,
       CASE WHEN pos < floor(count(*) OVER (PARTITION BY epoch, episode, task, emotion_ind) / 2)
            THEN 'support' ELSE 'query' END AS role
FROM episodes"""


def schedule_sql(batch: int, epochs: int, mode: str, cols: str) -> str:
    steps = "min(nb)" if mode in ("zip_shortest", "min") else "CAST(floor((max(nb) + min(nb)) / 2) AS BIGINT)"
    return FV + f""",
st AS (SELECT task, count(*) AS n, CAST(ceil(count(*) / {batch}.0) AS BIGINT) AS nb FROM fv GROUP BY 1),
ss AS (SELECT {steps} AS s FROM st),
draws AS (
  SELECT st.task, e.epoch, g AS step, g // st.nb AS pass, g % st.nb AS batch
  FROM st CROSS JOIN ss CROSS JOIN LATERAL (SELECT unnest(range(0, ss.s)) AS g)
  CROSS JOIN (SELECT unnest(range(0, {epochs})) AS epoch) e
),
passes AS (SELECT task, epoch, max(pass) AS mp FROM draws GROUP BY 1, 2),
expanded AS (
  SELECT {cols}, ps.epoch, p.pass FROM fv JOIN passes ps ON fv.task = ps.task
  CROSS JOIN LATERAL (SELECT unnest(range(0, ps.mp + 1)) AS pass) p
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task, epoch, pass
       ORDER BY md5('3:' || CAST(epoch AS VARCHAR) || ':' || CAST(pass AS VARCHAR) || ':' || row_id), row_id) AS rk
  FROM expanded
),
sched AS (
  SELECT r.*, CAST((r.rk - 1) % {batch} AS INTEGER) AS pos, CAST(d.step AS INTEGER) AS step_
  FROM ranked r JOIN draws d ON r.task = d.task AND r.epoch = d.epoch AND r.pass = d.pass
                            AND (r.rk - 1) // {batch} = d.batch
)"""


SQL["multitask_step_schedule"] = "WITH " + schedule_sql(16, 2, "mean_max_min", "fv.row_id, fv.task") + """
SELECT row_id, task, CAST(epoch AS INTEGER) AS epoch, step_ AS step, pos FROM sched"""

SQL["batch_support_query"] = "WITH " + schedule_sql(16, 1, "zip_shortest", "fv.row_id, fv.task, fv.emotion_ind") + """
SELECT row_id, task, emotion_ind, CAST(epoch AS INTEGER) AS epoch, step_ AS step, pos,
       CASE WHEN pos < floor(count(*) OVER (PARTITION BY epoch, step_, task) / 2) THEN 'support' ELSE 'query' END AS role
FROM sched"""

SQL["agg_value_counts"] = with_(CORPUS) + """,
vc AS (
  SELECT split, 'task' AS level, task, NULL AS emotion, NULL AS emotion_ind, count(*) AS n
  FROM corpus WHERE task IS NOT NULL GROUP BY split, task
  UNION ALL
  SELECT split, 'emotion', NULL, emotion, NULL, count(*) FROM corpus WHERE emotion IS NOT NULL GROUP BY split, emotion
  UNION ALL
  SELECT split, 'task_emotion_ind', task, NULL, emotion_ind, count(*) FROM corpus
  WHERE task IS NOT NULL AND emotion_ind IS NOT NULL GROUP BY split, task, emotion_ind
)
SELECT *, CAST(row_number() OVER (PARTITION BY split, level ORDER BY n DESC, task, emotion, emotion_ind) AS INTEGER) AS rank
FROM vc"""

SQL["corpus_build_balanced"] = with_(FD_SPLIT) + f""",
bsz AS (SELECT split, task, count(*) AS n FROM fd_split GROUP BY 1, 2),
bm AS (SELECT split, min(n) AS m FROM bsz GROUP BY 1),
br AS (SELECT *, row_number() OVER (PARTITION BY split, task ORDER BY md5('3:balance:' || row_id), row_id) AS rk
       FROM fd_split)
SELECT br.row_id, {sanitize_sql('br.tweet')} AS tweet, br.emotion, br.emotion_ind, br.task, br.split
FROM br JOIN bm ON br.split = bm.split WHERE br.rk <= bm.m"""

SQL["agg_class_cardinality"] = with_(FV_SPLIT) + """
SELECT task, count(DISTINCT emotion_ind) AS num_class FROM fv_split WHERE split = 'train' GROUP BY task"""

SQL["agg_min_group_size"] = with_(FV_SPLIT) + """
SELECT split, min(n) AS min_n FROM (SELECT split, task, count(*) AS n FROM fv_split GROUP BY 1, 2) GROUP BY split"""

SQL["agg_batch_counts"] = with_(FV_SPLIT) + """,
s AS (SELECT split, task, count(*) AS n, CAST(ceil(count(*) / 32.0) AS BIGINT) AS n_batches FROM fv_split GROUP BY 1, 2)
SELECT split, task, n, n_batches, min(n_batches) OVER w AS min_batches, max(n_batches) OVER w AS max_batches,
       CAST(sum(n_batches) OVER w AS BIGINT) AS total_batches
FROM s WINDOW w AS (PARTITION BY split)"""

# ---- prototypes, scoring, metrics ----------------------------------------------------------
SCORED = FV_SPLIT + """,
tr_el AS (
  SELECT task, emotion_ind, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM fv_split WHERE split = 'train'
),
protos AS (SELECT task, emotion_ind, i, avg(v) AS c FROM tr_el GROUP BY 1, 2, 3),
heads AS (
  SELECT task, emotion_ind AS k, i, 2 * c AS w, -sum(c * c) OVER (PARTITION BY task, emotion_ind) AS b FROM protos
),
val AS (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('3:0:0:' || row_id), row_id) AS rk
  FROM fv_split WHERE split = 'val'
),
val_el AS (SELECT row_id, task, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM val),
logits AS (
  SELECT e.row_id, e.task, h.k, sum(h.w * e.v) + min(h.b) AS logit
  FROM val_el e JOIN heads h ON e.task = h.task AND e.i = h.i GROUP BY 1, 2, 3
),
agg AS (
  SELECT row_id, max(logit) AS m, ln(sum(exp(logit - mx))) AS lse0
  FROM (SELECT *, max(logit) OVER (PARTITION BY row_id) AS mx FROM logits) GROUP BY row_id
),
scored AS (
  SELECT v.row_id, v.task, v.emotion_ind, CAST((v.rk - 1) // 32 AS BIGINT) AS batch,
         (SELECT min(l.k) FROM logits l WHERE l.row_id = v.row_id AND l.logit = a.m) AS pred,
         a.m + a.lse0 - (SELECT l.logit FROM logits l WHERE l.row_id = v.row_id AND l.k = v.emotion_ind) AS loss
  FROM val v JOIN agg a ON v.row_id = a.row_id
),
per_task AS (
  SELECT a.task, a.n, a.accuracy, b.loss, b.n_batches FROM
    (SELECT task, count(*) AS n, avg(CASE WHEN pred = emotion_ind THEN 1.0 ELSE 0.0 END) AS accuracy
     FROM scored GROUP BY task) a
  JOIN (SELECT task, avg(bl) AS loss, count(*) AS n_batches
        FROM (SELECT task, batch, avg(loss) AS bl FROM scored GROUP BY 1, 2) GROUP BY task) b ON a.task = b.task
)"""

SQL["proto_head"] = with_(SCORED) + """
SELECT task, k AS emotion_ind, round(b, 6) AS b, CAST(i AS INTEGER) AS i, round(w, 6) AS w FROM heads"""

SQL["proto_logits"] = with_(SCORED) + """
SELECT row_id, task, CAST(k AS INTEGER) AS k, round(logit, 6) AS logit FROM logits"""

SQL["predict_argmax"] = with_(SCORED) + "SELECT row_id, task, emotion_ind, CAST(pred AS INTEGER) AS pred FROM scored"

SQL["loss_cross_entropy"] = with_(SCORED) + "SELECT row_id, task, round(loss, 6) AS loss FROM scored"

SQL["agg_accuracy_micro"] = with_(SCORED) + "SELECT task, n, round(accuracy, 6) AS accuracy FROM per_task"

SQL["agg_loss_batch_mean"] = with_(SCORED) + "SELECT task, round(loss, 6) AS loss, n_batches FROM per_task"

SQL["agg_macro_task_mean"] = with_(SCORED) + """
SELECT count(*) AS n_tasks, round(avg(accuracy), 6) AS macro_accuracy, round(avg(loss), 6) AS macro_loss FROM per_task"""

SQL["job_evaluate_split"] = with_(SCORED) + """
SELECT task, n, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss, n_batches FROM per_task
UNION ALL
SELECT '__macro__', count(*), round(avg(accuracy), 6), round(avg(loss), 6), NULL FROM per_task"""

EP_ROLES = EPISODES + """,
roles AS (
  SELECT e.*, CASE WHEN pos < floor(count(*) OVER (PARTITION BY epoch, episode, task, emotion_ind) / 2)
                   THEN 'support' ELSE 'query' END AS role
  FROM episodes e
),
ep_el AS (
  SELECT r.epoch, r.episode, r.task, r.emotion_ind, r.row_id, r.role, unnest(f.x) AS v, unnest(range(0, len(f.x))) AS i
  FROM roles r JOIN fv f ON r.row_id = f.row_id
),
ep_obs AS (
  SELECT epoch, episode, task, emotion_ind, i, avg(v) AS c, count(*) AS n_el
  FROM ep_el WHERE role = 'support' GROUP BY 1, 2, 3, 4, 5
),
ep_groups AS (SELECT DISTINCT epoch, episode, task FROM roles),
ncls AS (SELECT task, count(DISTINCT emotion_ind) AS nc FROM fv GROUP BY task),
ep_spine AS (
  SELECT g.epoch, g.episode, g.task, CAST(c.k AS INTEGER) AS emotion_ind, d.i
  FROM ep_groups g JOIN ncls n ON g.task = n.task
  CROSS JOIN LATERAL (SELECT unnest(range(0, n.nc)) AS k) c
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(len(x)) FROM fv))) AS i) d
),
ep_protos AS (
  SELECT s.epoch, s.episode, s.task, s.emotion_ind, s.i, coalesce(o.c, CAST('NaN' AS DOUBLE)) AS c,
         coalesce(o.n_el, 0) AS n_el
  FROM ep_spine s LEFT JOIN ep_obs o ON s.epoch = o.epoch AND s.episode = o.episode AND s.task = o.task
                                     AND s.emotion_ind = o.emotion_ind AND s.i = o.i
)"""

SQL["agg_prototypes"] = with_(EP_ROLES) + """
SELECT epoch, episode, task, emotion_ind, CAST(n_el AS BIGINT) AS n_support, CAST(i AS INTEGER) AS i, round(c, 6) AS c
FROM ep_protos"""

ONE_SHOT = (EP_ROLES.replace("/ 10.0", "/ 1.0").replace("% 10 ", "% 1 ").replace("% 10)", "% 1)").replace("// 10 ", "// 1 ")
            .replace("range(0, ll.l * 2)", "range(0, ll.l)"))
SQL["agg_prototypes_one_shot"] = with_(ONE_SHOT) + """
SELECT epoch, episode, task, emotion_ind, CAST(max(n_el) AS BIGINT) AS n_support,
       CAST(count(*) FILTER (WHERE isnan(c)) AS INTEGER) AS n_nan
FROM ep_protos GROUP BY 1, 2, 3, 4"""

SQL["agg_accuracy_batch_mean"] = with_(EP_ROLES) + """,
ep_heads AS (
  SELECT epoch, episode, task, emotion_ind AS k, i, 2 * c AS w,
         -sum(c * c) OVER (PARTITION BY epoch, episode, task, emotion_ind) AS b FROM ep_protos
),
q_logits AS (
  SELECT e.epoch, e.episode, e.task, e.row_id, e.emotion_ind AS y, h.k, sum(h.w * e.v) + min(h.b) AS logit
  FROM ep_el e JOIN ep_heads h ON e.epoch = h.epoch AND e.episode = h.episode AND e.task = h.task AND e.i = h.i
  WHERE e.role = 'query' GROUP BY 1, 2, 3, 4, 5, 6
),
q_rows AS (
  SELECT epoch, episode, task, row_id, y,
         arg_min(k, CASE WHEN logit = mx THEN 0 ELSE 1 END * 1000 + k) AS pred,
         mx + ln(sum(exp(logit - mx))) - max(CASE WHEN k = y THEN logit END) AS loss
  FROM (SELECT *, max(logit) OVER (PARTITION BY epoch, episode, task, row_id) AS mx FROM q_logits)
  GROUP BY 1, 2, 3, 4, 5, mx
),
per_ep AS (
  SELECT epoch, episode, task, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS acc, avg(loss) AS ls
  FROM q_rows GROUP BY 1, 2, 3
)
SELECT count(*) AS n_episodes, round(avg(acc), 6) AS accuracy, round(avg(ls), 6) AS loss FROM per_ep"""
