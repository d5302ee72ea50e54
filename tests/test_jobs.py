"""Gradient jobs against NumPy on the same sampled rows (the oracles cover them in SQL)."""

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_paths import SF_SMALL
from taskweave.operators import interference as I
from taskweave.operators import sampling as P
from taskweave.plans import fixtures as X
from taskweave.plans import rounds as R
from taskweave.plans import training as TR


def weight(name, i, j):
    return (int(hashlib.md5(f"{name}:{i}:{j}".encode()).hexdigest()[:8], 16) % 2001 - 1000) / 10000.0


def matrix(name, n, m):
    return np.array([[weight(name, i, j) for j in range(m)] for i in range(n)])


def grads(Pm, W, b, x, y):
    z = x @ Pm.T
    logits = z @ W.T + b
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    delta = e / e.sum(axis=1, keepdims=True) - np.eye(len(W))[y]
    n = len(y)
    return W.T @ delta.T @ x / n, delta.T @ z / n, delta.sum(0) / n


@pytest.fixture(scope="module")
def train(spark):
    return P.split_holdout(X.fv(spark, SF_SMALL)).where(F.col("split") == "train")


def test_joint_gradients(train):
    got = {(r.epoch, r.step, r.task, r.param): r.g for r in TR.joint_gradients(train, epochs=2, batch_size=16).collect()}
    rows = P.multitask_step_schedule(train.select("row_id", "task", "emotion_ind", "x"), 16, epochs=2).collect()
    batches = defaultdict(list)
    for r in rows:
        batches[r.epoch, r.step, r.task].append(r)
    assert {k[:3] for k in got} == set(batches)
    for (epoch, step, task), b in batches.items():
        want = grads(matrix("P", 16, 64), matrix(task, 2, 16), np.zeros(2), np.array([r.x for r in b]), np.array([r.emotion_ind for r in b]))
        for param, g in zip(("encoder.P", "fc_layer.weight", "fc_layer.bias"), want):
            assert np.allclose(got[epoch, step, task, param], g.ravel() / 2)


def test_episode_adaptation(train):
    _, query = TR.episode_adaptation(train, k=10, epochs=1, alpha=0.3)
    got = {(r.epoch, r.episode, r.task): r for r in query.collect()}
    ep = P.episode_support_query(P.episode_sampler(train.select("row_id", "task", "emotion_ind", "x"), k=10, epochs=1)).collect()
    groups = defaultdict(list)
    for r in ep:
        groups[(r.epoch, r.episode, r.task), r.role].append(r)
    checked = 0
    for key, r in got.items():
        s, q = groups[key, "support"], groups[key, "query"]
        xs, ys, xq, yq = (np.array([getattr(a, c) for a in part]) for part in (s, q) for c in ("x", "emotion_ind"))
        if len(set(ys)) < 2:
            assert np.isnan(r.loss)      # the prototype of no row is NaN
            continue
        Pm = matrix("P", 16, 64)
        c = np.stack([xs[ys == k].mean(0) for k in (0, 1)]) @ Pm.T
        W, b = 2 * c, -(c * c).sum(1)
        gp, gw, gb = grads(Pm, W, b, xs, ys)
        want = grads(Pm - 0.3 * gp, W - 0.3 * gw, b - 0.3 * gb, xq, yq)
        for g, found in zip(want, (r.gP, r.gW, r.gb)):
            assert np.allclose(np.array(found), g)
        checked += 1
    assert checked


def test_similarity_of_late_steps_in_two_epochs(spark):
    """Steps above 100,000 and equal steps of different epochs stay apart: both columns are join keys."""
    r = np.random.default_rng(0)
    rows = [(e, s, t, "encoder.w", 0, 0, r.normal(size=4).tolist()) for e in (0, 1, 30000) for s in (0, 99_999, 100_000, 250_000) for t in "abc"]
    g = spark.createDataFrame(rows, "epoch int, step int, task string, param string, param_ord int, chunk int, g array<double>")
    got = {(x.epoch, x.step, x.pair, x.grp): x.similarity for x in I.group_cosines(g, I.task_pairs(I.task_order(g)), ["epoch", "step"]).collect()}
    by = {(e, s, t): np.array(v) for e, s, t, *_, v in rows}
    assert len(got) == 12 * 3 * 2
    for (e, s, pair, _), similarity in got.items():
        a, b = (by[e, s, t] for t in pair.split("-"))
        assert similarity == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_parameter_trajectory_in_blocks(spark):
    r = np.random.default_rng(1)
    u = r.normal(size=(70, 5))
    t0 = spark.createDataFrame([("p", 0, [1.0] * 5)], "param string, chunk int, g array<double>")
    steps = spark.createDataFrame([(i, "p", 0, v.tolist()) for i, v in enumerate(u)], "step int, param string, chunk int, g array<double>")
    for block in (1, 8, 1000):
        got = {x.step: x.g for x in I.parameter_trajectory(t0, steps, 0.1, block).collect()}
        want = 1 - 0.1 * np.cumsum(u, axis=0)
        assert all(np.allclose(got[i], want[i]) for i in range(70))


def test_pairs_are_complete(train):
    sims = I.group_cosines(TR.joint_gradients(train, epochs=1), I.task_pairs(I.task_order(train))).select("pair").distinct().collect()
    tasks = sorted(r.task for r in train.select("task").distinct().collect())
    assert sorted(r.pair for r in sims) == [f"{a}-{b}" for a, b in itertools.combinations(tasks, 2)]


def rows_by_task(rows):
    out = {}
    for r in rows.select("row_id", "task", "emotion_ind", "x").collect():
        out.setdefault(r.task, []).append(r)
    return {t: (np.array([r.x for r in v]), np.array([r.emotion_ind for r in v]), [r.row_id for r in v]) for t, v in sorted(out.items())}


def loss_of(Pm, W, b, x, y):
    logits = x @ Pm.T @ W.T + b
    top = logits.max(axis=1)
    return float(np.mean(top + np.log(np.exp(logits - top[:, None]).sum(1)) - logits[np.arange(len(y)), y])), float(np.mean(logits.argmax(1) == y))


def start(data):
    return matrix("P", 16, 64), {t: matrix(t, len(set(y)), 16) for t, (_, y, _) in data.items()}, {t: np.zeros(len(set(y))) for t, (_, y, _) in data.items()}


def joint_replica(data, Pm, W, b, rounds, rate):
    seen = {}
    for r in range(rounds + 1):
        g = {t: grads(Pm, W[t], b[t], x, y) for t, (x, y, _) in data.items()}
        seen |= {(r, t): (*loss_of(Pm, W[t], b[t], x, y), (Pm ** 2).sum(), (W[t] ** 2).sum()) for t, (x, y, _) in data.items()}
        if r < rounds:
            Pm = Pm - rate / 2 * sum(v[0] for v in g.values())
            W = {t: W[t] - rate / 2 * g[t][1] for t in W}
            b = {t: b[t] - rate / 2 * g[t][2] for t in b}
    return seen, Pm, W, b


def fomaml_replica(data, Pm, rounds, alpha, beta, inner):
    for r in range(rounds):
        total = 0
        for t, (x, y, ids) in data.items():
            order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"3:half{r}:{ids[i]}".encode()).hexdigest(), ids[i]))
            s, q = order[:len(ids) // 2], order[len(ids) // 2:]
            c = len(set(y))
            at = Pm, np.zeros((c, 16)), np.zeros(c)
            for _ in range(inner):
                at = tuple(a - alpha * g for a, g in zip(at, grads(*at, x[s], y[s])))
            total = total + grads(*at, x[q], y[q])[0]
        Pm = Pm - beta / len(data) * total
    return Pm


def test_joint_rounds_and_their_restart(spark, train, tmp_path):
    data = rows_by_task(train)
    want, Pm, W, b = joint_replica(data, *start(data), 3, 0.7)
    folder = f"file://{tmp_path}/run"
    R.joint_rounds(train, rounds=1, rate=0.7, folder=folder)          # a run that ended after its first round
    history, params = R.joint_rounds(train, rounds=3, rate=0.7, folder=folder)
    got = {(r["round"], r.task): (r.loss, r.accuracy, r.p_norm, r.w_norm) for r in history.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    for r in params.collect():
        assert np.allclose(np.array(r.P), Pm) and np.allclose(np.array(r.W), W[r.task]) and np.allclose(r.b, b[r.task])
    assert want[3, "t0"][0] < want[0, "t0"][0]


def test_fomaml_rounds_and_training_from_them(train):
    data = rows_by_task(train)
    history, params = R.fomaml_rounds(train, rounds=2, alpha=0.6, beta=0.4, inner_steps=3)
    Pm = fomaml_replica(data, start(data)[0], 2, 0.6, 0.4, 3)
    for r in params.collect():
        assert np.allclose(np.array(r.P), Pm) and not np.any(r.W) and not np.any(r.b)
    assert history.count() == 2 * len(data)
    later, _ = R.joint_rounds(train, rounds=1, rate=0.7, start=params)
    _, W, b = start(data)
    want, *_ = joint_replica(data, Pm, {t: 0 * w for t, w in W.items()}, b, 1, 0.7)
    got = {(r["round"], r.task): (r.loss, r.accuracy, r.p_norm, r.w_norm) for r in later.collect()}
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_sequential_rounds(spark, train):
    val = P.split_holdout(X.fv(spark, SF_SMALL)).where(F.col("split") == "val")
    data, held = rows_by_task(train), rows_by_task(val)
    first = TR.base_params(TR._rows(train))
    got = {(r["round"], r.task): (r.loss, r.accuracy) for r in R.sequential_rounds(train, val, first, rounds=2, rate=0.8, max_norm=0.05).collect()}
    Pm, W, b = start(data)
    W = {t: 0 * w for t, w in W.items()}
    for r in range(3):
        for t, (x, y, _) in held.items():
            assert np.allclose(got[r, t], loss_of(Pm, W[t], b[t], x, y))
        for t, (x, y, _) in data.items():
            g = grads(Pm, W[t], b[t], x, y)
            c = min(1, 0.05 / (np.sqrt(sum((v ** 2).sum() for v in g)) + 1e-6))
            Pm, W[t], b[t] = Pm - 0.8 * c * g[0], W[t] - 0.8 * c * g[1], b[t] - 0.8 * c * g[2]


def test_first_episode_is_the_samplers_first(train):
    columns = ["row_id", "task", "emotion_ind", "pos"]
    whole = P.episode_sampler(train, k=7, epochs=2).where("epoch = 0 AND episode = 0").select(*columns)
    assert sorted(map(tuple, P.first_episode(train, k=7).select(*columns).collect())) == sorted(map(tuple, whole.collect()))


def test_scan_in_levels(spark):
    r = np.random.default_rng(2)
    at = np.sort(r.choice(5000, 300, replace=False))        # places may be missing
    v = r.normal(size=(300, 3))
    rows = spark.createDataFrame([("a", int(i), x.tolist()) for i, x in zip(at, v)] + [("b", 4, [1.0, 2.0, 3.0])], "k string, at int, g array<double>")
    got = {(x.k, x.at): x.g for x in I.prefix_sums(rows, ["k"], block=4).collect()}
    assert len(got) == 301 and np.allclose([got["a", int(i)] for i in at], np.cumsum(v, axis=0)) and got["b", 4] == [1.0, 2.0, 3.0]
    assert I.prefix_sums(rows.limit(0), ["k"]).count() == 0
