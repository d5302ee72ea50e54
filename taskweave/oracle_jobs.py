"""DuckDB oracles of the gradient and adaptation jobs: one row for each vector component throughout."""

from __future__ import annotations

from .oracle import EPISODES, FV_SPLIT, SQL, schedule_sql, with_

WEIGHT = "((CAST('0x' || substr(md5({name} || ':' || CAST({i} AS VARCHAR) || ':' || CAST({j} AS VARCHAR)), 1, 8) AS BIGINT) % 2001) - 1000) / 10000.0::DOUBLE"
#: Training rows under the name that the sampling statements read.
TRAIN = FV_SPLIT + """,
trn AS (SELECT row_id, vec_id, task, emotion_ind, x FROM fv_split WHERE split = 'train')"""
PARAMS = TRAIN + f""",
hid AS (SELECT unnest(range(0, 16)) AS i),
dims AS (SELECT unnest(range(0, (SELECT max(len(x)) FROM trn))) AS j),
ncls AS (SELECT task, count(DISTINCT emotion_ind) AS nc FROM trn GROUP BY task),
p0 AS (SELECT i, j, {WEIGHT.format(name="'P'", i='i', j='j')} AS v FROM hid, dims),
w0 AS (SELECT task, k, i, {WEIGHT.format(name='task', i='k', j='i')} AS v
       FROM (SELECT task, unnest(range(0, nc)) AS k FROM ncls), hid)"""


def drop_fv(sql: str) -> str:
    """A sampling statement over the training rows instead of the whole fixture."""
    return sql[sql.index("cls AS") if "cls AS" in sql and sql.index("cls AS") < 1500 else sql.index("st AS"):].replace("FROM fv", "FROM trn").replace("fv.", "trn.")


def gradients(name: str, rows: str, p: str, w: str, b: str, key: str = "gk, task") -> str:
    """CTEs ``{name}_*``: scores and gradients of groups (``key``) of ``rows (gk, task, row_id, y, x)``.

    ``p (gk, task, i, j, v)``, ``w (gk, task, k, i, v)`` and ``b (gk, task, k, v)`` hold each group's parameters.
    """
    n = name
    return f""",
{n}_el AS (SELECT gk, task, row_id, y, unnest(x) AS v, unnest(range(0, len(x))) AS j FROM {rows}),
{n}_z AS (SELECT e.gk, e.task, e.row_id, p.i, sum(p.v * e.v) AS v FROM {n}_el e JOIN {p} p ON p.gk = e.gk AND p.task = e.task AND p.j = e.j GROUP BY 1, 2, 3, 4),
{n}_l AS (SELECT z.gk, z.task, z.row_id, w.k, sum(w.v * z.v) + min(b.v) AS l FROM {n}_z z
  JOIN {w} w ON w.gk = z.gk AND w.task = z.task AND w.i = z.i JOIN {b} b ON b.gk = z.gk AND b.task = z.task AND b.k = w.k GROUP BY 1, 2, 3, 4),
{n}_m AS (SELECT *, max(l) OVER r AS m FROM {n}_l WINDOW r AS (PARTITION BY gk, task, row_id)),
{n}_s AS (SELECT *, sum(exp(l - m)) OVER (PARTITION BY gk, task, row_id) AS s FROM {n}_m),
{n}_d AS (SELECT s.gk, s.task, s.row_id, r.y, s.k, s.l, s.m, s.s, exp(s.l - s.m) / s.s - CASE WHEN s.k = r.y THEN 1 ELSE 0 END AS d
  FROM {n}_s s JOIN {rows} r ON r.gk = s.gk AND r.task = s.task AND r.row_id = s.row_id),
{n}_r AS (SELECT gk, task, row_id, max(CASE WHEN k = y THEN m + ln(s) - l END) AS loss,
  CASE WHEN min(CASE WHEN l = m THEN k END) = min(y) THEN 1 ELSE 0 END AS ok FROM {n}_d GROUP BY 1, 2, 3),
{n}_q AS (SELECT {key}, count(*) AS n, avg(loss) AS loss, avg(CAST(ok AS DOUBLE)) AS accuracy FROM {n}_r GROUP BY {key}),
{n}_mt AS (SELECT d.gk, d.task, d.k, e.j, sum(d.d * e.v) / min(q.n) AS v FROM {n}_d d JOIN {n}_el e ON e.gk = d.gk AND e.task = d.task AND e.row_id = d.row_id
  JOIN {n}_q q ON q.gk = d.gk AND q.task = d.task GROUP BY 1, 2, 3, 4),
{n}_gp AS (SELECT m.gk, m.task, w.i, m.j, sum(w.v * m.v) AS v FROM {n}_mt m JOIN {w} w ON w.gk = m.gk AND w.task = m.task AND w.k = m.k GROUP BY 1, 2, 3, 4),
{n}_gw AS (SELECT m.gk, m.task, m.k, p.i, sum(p.v * m.v) AS v FROM {n}_mt m JOIN {p} p ON p.gk = m.gk AND p.task = m.task AND p.j = m.j GROUP BY 1, 2, 3, 4),
{n}_gb AS (SELECT d.gk, d.task, d.k, sum(d.d) / min(q.n) AS v FROM {n}_d d JOIN {n}_q q ON q.gk = d.gk AND q.task = d.task GROUP BY 1, 2, 3),
{n}_g AS (SELECT gk, task, 'encoder.P' AS param, i * 100000 + j AS ix, v FROM {n}_gp UNION ALL SELECT gk, task, 'fc_layer.weight', k * 100000 + i, v FROM {n}_gw
  UNION ALL SELECT gk, task, 'fc_layer.bias', k, v FROM {n}_gb)"""


def stepped(name: str, grads: str, p: str, w: str, b: str, alpha: float) -> str:
    """CTEs ``{name}_p, _w, _b``: the parameters after one step along ``grads``' gradients."""
    return f""",
{name}_p AS (SELECT p.gk, p.task, p.i, p.j, p.v - {alpha} * g.v AS v FROM {p} p JOIN {grads}_gp g USING (gk, task, i, j)),
{name}_w AS (SELECT w.gk, w.task, w.k, w.i, w.v - {alpha} * g.v AS v FROM {w} w JOIN {grads}_gw g USING (gk, task, k, i)),
{name}_b AS (SELECT b.gk, b.task, b.k, b.v - {alpha} * g.v AS v FROM {b} b JOIN {grads}_gb g USING (gk, task, k))"""


def groups_of(rows: str) -> str:
    """The formula's parameters for every group of ``rows``."""
    return f""",
gs AS (SELECT DISTINCT gk, task FROM {rows}),
bp AS (SELECT gs.gk, gs.task, p0.i, p0.j, p0.v FROM gs, p0),
bw AS (SELECT gs.gk, gs.task, w0.k, w0.i, w0.v FROM gs JOIN w0 ON w0.task = gs.task),
bb AS (SELECT DISTINCT gk, task, k, 0.0::DOUBLE AS v FROM bw)"""


def prototype_heads(rows: str, p: str = "bp", x: str = "") -> str:
    """CTEs ``hw, hb`` (names after ``x``): heads from the class means of ``rows`` after the encoder ``p``."""
    return f""",
{x}pa AS (SELECT gk, task, y AS k, j, avg(v) AS v FROM (SELECT gk, task, y, unnest(x) AS v, unnest(range(0, len(x))) AS j FROM {rows}) GROUP BY 1, 2, 3, 4),
{x}pk AS (SELECT gs.gk, gs.task, c.k, dims.j FROM gs JOIN (SELECT task, unnest(range(0, nc)) AS k FROM ncls) c ON c.task = gs.task, dims),
{x}pm AS (SELECT k.gk, k.task, k.k, k.j, coalesce(a.v, CAST('NaN' AS DOUBLE)) AS v  -- the mean of no row
  FROM {x}pk k LEFT JOIN {x}pa a ON a.gk = k.gk AND a.task = k.task AND a.k = k.k AND a.j = k.j),
{x}pz AS (SELECT c.gk, c.task, c.k, p.i, sum(p.v * c.v) AS v FROM {x}pm c JOIN {p} p ON p.gk = c.gk AND p.task = c.task AND p.j = c.j GROUP BY 1, 2, 3, 4),
{x}hw AS (SELECT gk, task, k, i, 2 * v AS v FROM {x}pz),
{x}hb AS (SELECT gk, task, k, -sum(v * v) AS v FROM {x}pz GROUP BY 1, 2, 3)"""


def cosines(name: str, scale: float = 1.0) -> str:
    return f""",
cg AS (SELECT gk, task, param, ix, v * {scale} AS v, CASE WHEN contains(param, 'fc_layer') THEN 'fc_layer' ELSE 'encoder' END AS grp FROM {name}_g
  UNION ALL SELECT gk, task, param, ix, v * {scale}, 'all_model' FROM {name}_g),
cs AS (SELECT a.gk, a.task || '-' || b.task AS pair, a.grp, sum(a.v * b.v) AS d, sum(a.v * a.v) AS n1, sum(b.v * b.v) AS n2
  FROM cg a JOIN cg b ON a.gk = b.gk AND a.grp = b.grp AND a.param = b.param AND a.ix = b.ix AND a.task < b.task GROUP BY 1, 2, 3),
sim AS (SELECT gk, pair, grp, round(CASE WHEN n1 = 0 OR n2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE d / (sqrt(n1) * sqrt(n2)) END, 6) AS similarity FROM cs)"""


STEPS = PARAMS + ",\n" + drop_fv(schedule_sql(32, 2, "mean_max_min", "fv.row_id, fv.task, fv.emotion_ind, fv.x")) + """,
b AS (SELECT struct_pack(a := epoch, s := step_) AS gk, task, row_id, emotion_ind AS y, x FROM sched)"""
SQL["job_joint_multitask"] = with_(STEPS + groups_of("b") + gradients("g", "b", "bp", "bw", "bb") + cosines("g", 0.5)) + """
SELECT CAST(gk.a AS INTEGER) AS epoch, CAST(gk.s AS INTEGER) AS step, pair, grp, similarity FROM sim"""

HALVES = PARAMS + ",\n" + drop_fv(schedule_sql(16, 1, "zip_shortest", "fv.row_id, fv.task, fv.emotion_ind, fv.x")) + """,
h AS (SELECT step_ AS gk, task, row_id, emotion_ind AS y, x,
             CASE WHEN pos < floor(count(*) OVER (PARTITION BY epoch, step_, task) / 2) THEN 'support' ELSE 'query' END AS role FROM sched),
sup AS (SELECT * FROM h WHERE role = 'support'), qry AS (SELECT * FROM h WHERE role = 'query')"""
SQL["job_fomaml"] = with_(HALVES + groups_of("h") + gradients("s", "sup", "bp", "bw", "bb") + stepped("a", "s", "bp", "bw", "bb", 0.01)
                          + gradients("q", "qry", "a_p", "a_w", "a_b")) + """,
nt AS (SELECT gk, count(DISTINCT task) AS nt FROM q_g GROUP BY gk),
sh AS (SELECT g.gk, g.ix, sum(g.v) / min(nt.nt) AS v FROM q_g g JOIN nt ON nt.gk = g.gk WHERE g.param = 'encoder.P' GROUP BY 1, 2)
SELECT CAST(q.gk AS INTEGER) AS step, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(min(n.sq_norm), 6) AS sq_norm
FROM q_q q JOIN (SELECT gk, sum(v * v) AS sq_norm FROM sh GROUP BY gk) n ON n.gk = q.gk GROUP BY q.gk"""


def episode_sql(epochs: int, only: str = "") -> str:
    drawn = drop_fv(EPISODES).replace("range(0, ll.l * 2)", f"range(0, ll.l * {epochs})")
    params = PARAMS.replace("FROM fv_split WHERE split = 'train'", f"FROM fv_split WHERE split = 'train' {only}")
    return params + ",\n" + drawn + """,
er AS (SELECT e.epoch, e.episode, e.task, e.row_id, e.emotion_ind AS y, f.x,
              CASE WHEN e.pos < floor(count(*) OVER (PARTITION BY e.epoch, e.episode, e.task, e.emotion_ind) / 2) THEN 'support' ELSE 'query' END AS role
       FROM episodes e JOIN trn f ON e.row_id = f.row_id),
eg AS (SELECT struct_pack(a := epoch, s := episode) AS gk, task, row_id, y, x, role FROM er),
sup AS (SELECT * FROM eg WHERE role = 'support'), qry AS (SELECT * FROM eg WHERE role = 'query')"""


def adapted(epochs: int = 2, only: str = "") -> str:
    return (episode_sql(epochs, only) + groups_of("eg") + prototype_heads("sup") + gradients("s", "sup", "bp", "hw", "hb")
            + stepped("a", "s", "bp", "hw", "hb", 0.05) + gradients("q", "qry", "a_p", "a_w", "a_b"))


SQL["job_protomaml"] = with_(adapted()) + """
SELECT CAST(gk.a AS INTEGER) AS epoch, CAST(gk.s AS INTEGER) AS episode, task, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM q_q"""

SQL["job_protomaml_similarity"] = with_(adapted() + cosines("s")) + """
SELECT CAST(gk.a AS INTEGER) AS epoch, CAST(gk.s AS INTEGER) AS episode, pair, grp, similarity FROM sim"""

SQL["job_conflict_study"] = with_(adapted(1, "AND task IN ('t0', 't1')")) + """,
og AS (SELECT gk.s AS episode, task, param, ix, v, 'inner' AS phase FROM s_g UNION ALL SELECT gk.s, task, param, ix, v, 'outer' FROM q_g),
kd AS (SELECT CAST(episode // 2 AS INTEGER) AS step, CASE WHEN episode % 2 = 0 THEN 'episode' ELSE 'ref' END AS kind, task, param, ix, v, phase FROM og),
cb AS (SELECT a.task || '_' || b.task AS pair, a.step, a.phase, a.param, a.v AS va, b.v AS vb
       FROM kd a JOIN kd b ON a.step = b.step AND a.phase = b.phase AND a.param = b.param AND a.ix = b.ix AND a.kind = 'episode'
        AND (a.task = 't0' AND b.task = 't1' AND b.kind = 'episode' OR a.task = b.task AND b.kind = 'ref'))
SELECT step, phase, pair, param, round(CASE WHEN sum(va * va) = 0 OR sum(vb * vb) = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE sum(va * vb) / (sqrt(sum(va * va)) * sqrt(sum(vb * vb))) END, 6) AS similarity
FROM cb GROUP BY 1, 2, 3, 4"""


def evaluated(p: str, w: str, b: str) -> str:
    """Validation rows scored with the parameters of the first episode."""
    return f""",
val AS (SELECT struct_pack(a := 0, s := 0) AS gk, task, row_id, emotion_ind AS y, x,
               (row_number() OVER (PARTITION BY task ORDER BY md5('3:0:0:' || row_id), row_id) - 1) // 32 AS batch FROM fv_split WHERE split = 'val')""" + gradients("v", "val", p, w, b) + """,
pb AS (SELECT r.task, v.batch, count(*) AS n, sum(r.ok) AS ok, avg(r.loss) AS bl FROM v_r r JOIN val v ON v.row_id = r.row_id GROUP BY 1, 2),
pt AS (SELECT task, sum(ok) / sum(n) AS accuracy, avg(bl) AS loss FROM pb GROUP BY task)
SELECT task, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss FROM pt
UNION ALL SELECT '__macro__', round(avg(accuracy), 6), round(avg(loss), 6) FROM pt"""


FIRST = (episode_sql(1) + groups_of("eg") + prototype_heads("sup")).replace("FROM er)", "FROM er WHERE epoch = 0 AND episode = 0)")
SQL["job_adapt_evaluate_zero"] = with_(FIRST + evaluated("bp", "hw", "hb"))
SQL["job_adapt_evaluate"] = with_(FIRST + gradients("s", "sup", "bp", "hw", "hb") + stepped("a", "s", "bp", "hw", "hb", 0.05) + evaluated("a_p", "a_w", "a_b"))


def adapted_by_query() -> str:
    """The support step, then heads from the query rows' class means after the adapted encoder."""
    steps = episode_sql(2) + groups_of("eg") + prototype_heads("sup") + gradients("s", "sup", "bp", "hw", "hb") + stepped("a", "s", "bp", "hw", "hb", 0.05)
    return steps + prototype_heads("qry", "a_p", "q") + gradients("q", "qry", "a_p", "qhw", "qhb")


SQL["job_protomaml_query_prototypes"] = with_(adapted_by_query()) + """
SELECT CAST(gk.a AS INTEGER) AS epoch, CAST(gk.s AS INTEGER) AS episode, task, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM q_q"""

WHOLE = PARAMS + """,
b AS (SELECT 0 AS gk, task, row_id, emotion_ind AS y, x FROM trn)""" + groups_of("b")


def outer(name: str, grads: str, p: str, rate: str) -> str:
    """CTE ``{name}``: the common encoder after a step against the sum over the tasks."""
    return f""",
{name} AS (SELECT p.gk, p.task, p.i, p.j, p.v - {rate} * s.v AS v FROM {p} p JOIN (SELECT i, j, sum(v) AS v FROM {grads}_gp GROUP BY 1, 2) s USING (i, j))"""


def joint(first: int, rounds: int, p: str, w: str, b: str, rate: float) -> tuple[str, list[str]]:
    """CTEs of ``rounds`` joint rounds (names from number ``first`` on), and the statements that read them."""
    sql, reads = "", []
    for r in range(rounds + 1):
        n = f"j{first + r}"
        sql += gradients(n, "b", p, w, b)
        reads.append(f"""SELECT {r} AS round, q.task, q.n, round(q.loss, 6) AS loss, round(q.accuracy, 6) AS accuracy,
       round((SELECT sum(v * v) FROM {p} x WHERE x.task = q.task), 6) AS p_norm, round((SELECT sum(v * v) FROM {w} x WHERE x.task = q.task), 6) AS w_norm FROM {n}_q q""")
        if r < rounds:
            sql += outer(f"{n}o", n, p, str(rate / 2)) + stepped(f"{n}s", n, p, w, b, rate / 2)
            p, w, b = f"{n}o", f"{n}s_w", f"{n}s_b"
    return sql, reads


def fomaml(rounds: int, alpha: float, beta: float, inner: int) -> tuple[str, list[str], str]:
    """CTEs of ``rounds`` first-order rounds with zero heads ``zw, zb``, the statements that read them, and the last encoder."""
    sql, reads, p = """,
zw AS (SELECT gk, task, k, i, 0.0::DOUBLE AS v FROM bw), zb AS (SELECT gk, task, k, 0.0::DOUBLE AS v FROM bb)""", [], "bp"
    for r in range(rounds):
        n = f"f{r}"
        sql += f""",
{n}h AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('3:half{r}:' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY task) / 2) AS support FROM b),
{n}u AS (SELECT * FROM {n}h WHERE support), {n}y AS (SELECT * FROM {n}h WHERE NOT support)"""
        at = (p, "zw", "zb")
        for i in range(inner):
            sql += gradients(f"{n}i{i}", f"{n}u", *at) + stepped(f"{n}a{i}", f"{n}i{i}", *at, alpha)
            at = tuple(f"{n}a{i}_{x}" for x in "pwb")
        sql += gradients(f"{n}q", f"{n}y", *at) + outer(f"{n}o", f"{n}q", p, f"{beta} / (SELECT count(*) FROM ncls)")
        reads.append(f"""SELECT {r} AS round, q.task, q.n, round(q.loss, 6) AS loss, round(q.accuracy, 6) AS accuracy,
       round((SELECT sum(v * v) FROM {at[0]} x WHERE x.task = q.task), 6) AS p_norm, round((SELECT sum(v * v) FROM {at[1]} x WHERE x.task = q.task), 6) AS w_norm FROM {n}q_q q""")
        p = f"{n}o"
    return sql, reads, p


_CTES, _READS = joint(0, 3, "bp", "bw", "bb", 1.0)
SQL["job_joint_rounds"] = with_(WHOLE + _CTES) + " UNION ALL ".join(_READS)
_CTES, _READS, _ = fomaml(2, 1.0, 1.0, 2)
SQL["job_fomaml_rounds"] = with_(WHOLE + _CTES) + " UNION ALL ".join(_READS)
_INIT, _, _P = fomaml(1, 1.0, 1.0, 1)
_CTES, _READS = joint(0, 2, _P, "zw", "zb", 1.0)
SQL["job_train_from_saved_init"] = with_(WHOLE + _INIT + _CTES) + " UNION ALL ".join(_READS)


def sequential(tasks: int, p: str, w: str, b: str, rate: float) -> tuple[str, list[str]]:
    """One round of the first ``tasks`` tasks, one after another with clipping at norm 1, and validation before and after."""
    sql, reads = """,
vb AS (SELECT 0 AS gk, task, row_id, emotion_ind AS y, x FROM fv_split WHERE split = 'val'),
tk AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS place FROM ncls)""", []

    def score(r):
        reads.append(f"SELECT {r} AS round, task, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM v{r}_q")
        return gradients(f"v{r}", "vb", p, w, b)

    sql += score(0)
    for t in range(tasks):
        n = f"t{t}"
        sql += f""",
{n}r AS (SELECT b.* FROM b JOIN tk ON tk.task = b.task WHERE tk.place = {t})""" + gradients(n, f"{n}r", p, w, b) + f""",
{n}c AS (SELECT {rate} * least(1.0::DOUBLE, 1.0 / (sqrt(coalesce((SELECT sum(v * v) FROM {n}_gp), 0) + coalesce((SELECT sum(v * v) FROM {n}_gw), 0)
  + coalesce((SELECT sum(v * v) FROM {n}_gb), 0)) + 1e-6)) AS c),
{n}p AS (SELECT p.gk, p.task, p.i, p.j, p.v - {n}c.c * coalesce(g.v, 0) AS v FROM {p} p LEFT JOIN {n}_gp g ON g.i = p.i AND g.j = p.j, {n}c),
{n}w AS (SELECT w.gk, w.task, w.k, w.i, w.v - {n}c.c * coalesce(g.v, 0) AS v FROM {w} w LEFT JOIN {n}_gw g ON g.task = w.task AND g.k = w.k AND g.i = w.i, {n}c),
{n}b AS (SELECT b.gk, b.task, b.k, b.v - {n}c.c * coalesce(g.v, 0) AS v FROM {b} b LEFT JOIN {n}_gb g ON g.task = b.task AND g.k = b.k, {n}c)"""
        p, w, b = f"{n}p", f"{n}w", f"{n}b"
    sql += score(1)
    return sql, reads


_CTES, _READS = sequential(5, _P, "zw", "zb", 1.0)
SQL["job_finetune_sequential"] = with_(WHOLE + _INIT + _CTES) + " UNION ALL ".join(_READS)
