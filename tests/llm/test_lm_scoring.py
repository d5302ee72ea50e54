import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from taskweave.llm import lm_scoring, word_exchange
from taskweave.llm.attention import Learner, Model, Scorer, Shape, moved, train
from taskweave.llm.byte_bpe import merge

SMALL = Shape(width=8, mixtures=6, window=12, stride=5, steps=60, batch=16)
RANKS = {bytes([b]): b for b in range(256)} | {b" t": 256, b"th": 257, b" th": 258, b"he": 259, b" a": 260}


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def tokens(text):
    return (text or "").encode().lower().split()


def test_gradients():
    r = np.random.default_rng(0)
    counts = r.integers(1, 9, 20)
    model = Model.fresh(Shape(width=4, mixtures=3, window=6, stride=3), counts)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    ids, after = r.integers(0, 20, (5, 6)), r.integers(0, 20, (5, 6))

    def loss():
        return -np.log((model.forward(ids)[0] * model.table[after]).sum(-1)).mean()

    weights, kept = model.forward(ids)
    wanted = weights * model.table[after]
    wanted /= wanted.sum(-1, keepdims=True)
    found = model.gradients(ids, weights, wanted, kept)
    for name, p in model.params.items():
        at = tuple(r.integers(0, s) for s in p.shape) if name != "embed" else (int(ids[0, 0]), 1)
        old, step = p[at], 1e-5
        p[at] = old + step
        up = loss()
        p[at] = old - step
        assert found[name][at] == pytest.approx((up - loss()) / (2 * step), abs=1e-5), name
        p[at] = old


def test_windows_score_each_subword_once_and_never_look_ahead():
    r = np.random.default_rng(1)
    counts = r.integers(1, 50, 30)
    model = train(r.integers(0, 30, (80, SMALL.window + 1)), counts, SMALL)
    begins = np.arange(10, 30)
    scorer = Scorer(model, begins, batch=7)
    lengths = np.array([1, 3, SMALL.window, SMALL.window + 1, 40, 2])
    ids = r.integers(0, 30, lengths.sum())
    got, got_b = scorer.score(ids, lengths, end=29)
    at = 0
    for n in lengths:
        doc = [29, *ids[at:at + n]]
        for t in range(n):
            start = 0 if t < SMALL.window else -(-(t + 1 - SMALL.window) // SMALL.stride) * SMALL.stride
            weights, _ = model.forward(np.array([doc[start:t + 1]]))
            assert got[at + t] == pytest.approx(math.log(weights[0, -1] @ model.table[doc[t + 1]]), abs=2e-4)
            assert got_b[at + t] == pytest.approx(math.log(weights[0, -1] @ model.table[begins].sum(0)), abs=2e-4)
        at += n


def sample_docs(spark, odd_docs):
    r = random.Random(2)
    tongues = [[a + b for a in ("the", "tha", "a") for b in ("", "s", "t")], [a + b for a in ("Qu", "mi", "zo") for b in ("o", "x", "rr")]]
    rows = [(1000 + i, " ".join(r.choice(tongues[i % 2]) for _ in range(r.randint(1, 60)))) for i in range(80)]
    return odd_docs.select("doc_id", "text", "part", "`__kept`").unionByName(spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, part string, `__kept` int"))


def test_counts_and_base_scores(spark, odd_docs):
    docs = sample_docs(spark, odd_docs)
    rows = docs.collect()
    c = Counter()
    for r in rows:
        if not held_out(r.doc_id):
            c.update(tokens(r.text))
            c[None] += 1
    n, v = sum(c.values()), len(c)

    def want(r):
        t = [*tokens(r.text), None]
        return (r.doc_id, held_out(r.doc_id), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6))

    scored = lm_scoring.score_documents(spark, docs, RANKS, shape=SMALL).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == Counter(map(want, rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def test_held_out_texts_score_better_than_the_base(spark, odd_docs):
    longer = Shape(width=8, mixtures=6, window=12, stride=5, steps=250, batch=24, smooth=20.0)
    scored = [r for r in lm_scoring.score_documents(spark, sample_docs(spark, odd_docs), RANKS, shape=longer).collect() if r.held_out and (r.doc_id or 0) >= 1000]
    assert len(scored) > 5 and sum(r.score for r in scored) > sum(r.base_score for r in scored)


def test_probabilities_of_all_next_words_sum_to_one(spark):
    """Over an alphabet of two letters, words of up to three letters hold nearly all the mass of the next word."""
    ranks = {b" ": 0, b"a": 1, b"b": 2, b" a": 3, b" b": 4}
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
    known = [(10 + i, "a ab a") for i in range(12)]
    probes = [(j, f"ab {w}") for j, w in zip((i for i in range(10 ** 6, 10 ** 7) if held_out(i)), words)]
    ends = [(j, "ab") for j in [next(i for i in range(10 ** 7, 10 ** 8) if held_out(i))]]
    docs = spark.createDataFrame(known + probes + ends, "doc_id long, text string")
    shape = Shape(width=4, mixtures=3, window=8, stride=4, steps=80, batch=8, smooth=1.0)
    scored = {r.doc_id: r.score for r in lm_scoring.score_documents(spark, docs, ranks, shape=shape, share=0.3).collect()}
    # P(ab w end) summed over w and P(ab end): at most P(ab), which is at most 1
    total = sum(10 ** scored[i] for i, _ in probes + ends)
    assert 0 < total <= 1.0 + 1e-6


def test_empty_table_and_no_training_documents(spark, no_docs):
    assert lm_scoring.score_documents(spark, no_docs, RANKS, shape=SMALL).count() == 0
    only = next(i for i in range(100) if held_out(i))
    (r,) = lm_scoring.score_documents(spark, spark.createDataFrame([(only, "a b")], "doc_id long, text string"), RANKS, shape=SMALL).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and math.isfinite(r.base_score)


def test_subwords_outside_the_attention_sample_are_learnt(spark):
    """The attention sees one document of a common language; a rarer one is in no sample, but in the training documents."""
    r = random.Random(4)
    common = [(i, " ".join(r.choice(["the", "tha", "a"]) for _ in range(30))) for i in range(300)]
    rare = [(1000 + i, " ".join(r.choice(["qu", "mi", "zo"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string")
    ranks = RANKS | {b" q": 261, b" m": 262, b" z": 263}
    scored = lm_scoring.score_documents(spark, docs, ranks, shape=SMALL, sample_docs=1, sample_windows=2).collect()
    gains = [(x.score - x.base_score) / x.n_tokens for x in scored if x.held_out and x.doc_id >= 1000]
    assert len(gains) > 3 and sum(gains) / len(gains) > -0.3


def test_expected_counts_are_those_of_every_training_subword(spark, odd_docs, monkeypatch):
    docs = sample_docs(spark, odd_docs)
    want = np.zeros(max(RANKS.values()) + 2)
    for r in docs.collect():
        if not held_out(r.doc_id):
            for i in [i for w in tokens(r.text) for i in merge(b" " + w, RANKS)] + [len(want) - 1]:
                want[i] += 1
    got = []
    kept = lm_scoring.retabled
    monkeypatch.setattr(lm_scoring, "retabled", lambda model, seen, counts: got.append(seen) or kept(model, seen, counts))
    lm_scoring.score_documents(spark, docs, RANKS, shape=SMALL, sample_docs=2, sample_windows=1)
    np.testing.assert_allclose(got[0].sum(1), want, rtol=1e-4, atol=1e-3)


def test_every_training_window_moves_the_attention(spark, odd_docs, monkeypatch):
    """Each place of each training document is met once by the gradient steps."""
    docs = sample_docs(spark, odd_docs)
    want = np.zeros(max(RANKS.values()) + 2)
    for r in docs.collect():
        if not held_out(r.doc_id):
            for i in [len(want) - 1] + [i for w in tokens(r.text) for i in merge(b" " + w, RANKS)]:
                want[i] += 1
    got = []
    kept = lm_scoring.moved
    monkeypatch.setattr(lm_scoring, "moved", lambda model, met, *a: got.append(met) or kept(model, met, *a))
    lm_scoring.score_documents(spark, docs, RANKS, shape=SMALL)
    np.testing.assert_array_equal(got[0], want)


def test_places_outside_documents_are_not_learnt():
    r = np.random.default_rng(6)
    shape = Shape(width=4, mixtures=4, window=6, stride=3)
    model = Model.fresh(shape, r.integers(1, 9, 20))
    ids, after, inside = r.integers(0, 20, (5, 6)), r.integers(0, 20, (5, 6)), np.arange(6) < np.array([6, 2, 1, 6, 5])[:, None]
    one, other = Learner(model), Learner(model)
    one.step(ids, after, inside)
    other.step(np.where(inside, ids, 7), np.where(inside, after, 3), inside)
    for a, b in zip((one.seen, *one.change()), (other.seen, *other.change())):
        np.testing.assert_allclose(a, b, atol=1e-6)
    np.testing.assert_allclose(one.seen.sum(1), np.bincount(after[inside], minlength=20), atol=1e-5)


def test_a_learners_steps_are_those_of_the_gradients():
    r = np.random.default_rng(3)
    shape = Shape(width=4, mixtures=3, window=6, stride=3)
    model = Model.fresh(shape, r.integers(1, 9, 20))
    ids, after = r.integers(0, 20, (5, 6)), r.integers(0, 20, (5, 6))
    weights, kept = model.forward(ids)
    wanted = weights * model.table[after]
    wanted /= wanted.sum(-1, keepdims=True)
    grads = model.gradients(ids, weights, wanted, kept)
    learner = Learner(model)
    learner.step(ids, after, np.ones(ids.shape, bool))
    met, vectors, dense = learner.change()
    np.testing.assert_allclose(met, np.bincount(ids.reshape(-1), minlength=20))
    one = moved(model, met, vectors, dense, 1)
    for name, g in grads.items():
        if name == "embed":
            change = -Learner.VECTOR_RATE * g / np.sqrt(1e-6 + (g * g).mean(1, keepdims=True))
        else:
            change = -Learner.RATE / 20 * g / (np.abs(g) + 1e-8)
        np.testing.assert_allclose(one.params[name], model.params[name] + change, atol=2e-4, err_msg=name)
    # two tasks: vectors by how often each met a subword, matrices by their steps
    two = moved(model, 2 * met, vectors, dense * 3, 4)
    np.testing.assert_allclose(two.params["embed"] - model.params["embed"], (one.params["embed"] - model.params["embed"]) / 2, atol=1e-6)
    np.testing.assert_allclose(two.params["mix"] - model.params["mix"], (one.params["mix"] - model.params["mix"]) * 0.75, atol=1e-6)


def test_learning_in_tasks_lowers_the_loss():
    r = np.random.default_rng(5)
    shape = Shape(width=8, mixtures=6, window=12, stride=5, steps=40, batch=16)
    ids = np.cumsum(r.integers(0, 3, 6000)) % 30  # the next subword follows from the last one
    counts = np.bincount(ids, minlength=31)
    windows = np.stack([ids[i:i + 13] for i in range(0, 400, 12)])
    model = train(windows, counts, shape)
    learner, lengths = Learner(model), np.array([len(ids)])
    for at, before, inside, _ in Scorer.windows(ids, lengths, 30, shape, shape.window, 16):
        learner.step(before, ids[at], inside)
    met, vectors, dense = learner.change()
    score = lambda m: Scorer(m, np.arange(31)).score(ids, lengths, 30)[0].mean()
    assert score(moved(model, met, vectors, dense, learner.steps)) > score(model) + 0.05


def test_scores_by_their_definition(spark, odd_docs, monkeypatch):
    """Every word's probability from the model's plain forward pass and plain counts."""
    docs = sample_docs(spark, odd_docs)
    models = []
    kept = lm_scoring.retabled
    monkeypatch.setattr(lm_scoring, "retabled", lambda *a: models.append(kept(*a)) or models[-1])
    scored = lm_scoring.score_documents(spark, docs, RANKS, shape=SMALL, share=0.3, discount=0.6, learn_every=2).collect()
    model, end = models[-1], max(RANKS.values()) + 1
    begins = [i for t, i in RANKS.items() if t[:1] == b" "] + [end]
    spelling = lambda w: merge(b" " + w, RANKS)
    counts, total, kinds = Counter(), Counter(), Counter()
    rows = docs.collect()
    for r in rows:
        if not held_out(r.doc_id):
            counts.update([*tokens(r.text), None])
    for w, n in counts.items():
        first = end if w is None else spelling(w)[0]
        total[first] += n
        kinds[first] += 1

    def score(text):
        ids, starts = [end], []
        for w in tokens(text):
            starts.append((w, len(ids)))
            ids += spelling(w)
        starts.append((None, len(ids)))
        ids.append(end)
        p, b = {}, {}
        for t in range(len(ids) - 1):
            start = 0 if t < SMALL.window else -(-(t + 1 - SMALL.window) // SMALL.stride) * SMALL.stride
            weights = model.forward(np.array([ids[start:t + 1]]))[0][0, -1]
            p[t + 1], b[t + 1] = float(weights @ model.table[ids[t + 1]]), float(weights @ model.table[begins].sum(0))
        out = 0.0
        for k, (w, at) in enumerate(starts):
            last = starts[k + 1][1] if k + 1 < len(starts) else len(ids)
            rest = math.prod(p[i] for i in range(at + 1, last)) * (b[last] if w is not None else 1.0)
            first, c = ids[at], counts[w]
            by_count = 0.7 * max(c - 0.6, 0) / total[first] if total[first] else 0.0
            by_spelling = (0.3 + 0.7 * 0.6 * kinds[first] / total[first] if total[first] else 1.0) * rest
            out += math.log10(p[at] / b[at] * (by_count + by_spelling))
        return out

    short = [r for r in rows if len(r.text or "") < 400]
    got, want = Counter(), Counter()
    for r in scored:
        if (r.doc_id, r.n_tokens) in {(x.doc_id, len(tokens(x.text)) + 1) for x in short}:
            got[r.doc_id] += r.score
    for r in short:
        want[r.doc_id] += score(r.text)
    assert len(want) > 80 and all(got[i] == pytest.approx(want[i], rel=1e-3, abs=2e-2) for i in want)


ODD_TEXTS = [" A  b\t\x0bC\r\n\x0c", "", None, "x", "\x1c\x85 \xc9\xa0 z K", "   ", "b a A \xe9", "\n"]


def test_words_of_whole_columns_are_those_of_each_text():
    splitter, numbers = word_exchange.SpacedWords(), word_exchange.Numbers()
    column = pa.array(["skipped", *ODD_TEXTS])
    splitter.add(column.slice(1, 3))
    splitter.add(column.slice(4))
    flat, lengths, words = splitter.done()
    want = [[numbers[w] for w in tokens(t)] for t in ODD_TEXTS]
    assert flat.tolist() == [n for x in want for n in x] and lengths.tolist() == [len(x) for x in want] and words == list(numbers)
    splitter = word_exchange.SpacedWords()
    splitter.add(pa.array([None, ""], pa.string()))
    flat, lengths, words = splitter.done()
    assert (len(flat), lengths.tolist(), words) == (0, [0, 0], [])


def test_packed_batches_are_those_of_words_numbered_one_by_one(monkeypatch):
    """The same rows, byte for byte, whichever way words are numbered and wherever batches end."""
    def one_by_one():
        numbers = word_exchange.Numbers()
        return (lambda text: map(numbers.__getitem__, tokens(text))), numbers

    monkeypatch.setattr(word_exchange, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    r = random.Random(8)
    texts = [r.choice(ODD_TEXTS) if r.random() < 0.2 else " ".join(r.choice(["the", "The", "a", "zo\xe9", str(r.randint(0, 99))]) for _ in range(r.randint(0, 40))) for _ in range(600)]
    rows = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 600)], pa.int64()), pa.array([i % 3 == 0 for i in range(600)]).cast(pa.int32()), pa.array(texts)], ["doc_id", "mark", "text"])
    for size in (1, 100, 5000, 1 << 20):
        got, want = (list(word_exchange.pack_batches([rows.slice(0, 50), rows.slice(50)], f, 4, size, True)) for f in (word_exchange.SpacedWords, one_by_one))
        assert len(got) == len(want) and all(a.equals(b) for a, b in zip(got, want))
        assert len(got) > (1 if size < 1 << 20 else 0)


def test_a_step_in_parts_is_the_step_on_all_windows(monkeypatch):
    r = np.random.default_rng(7)
    shape = Shape(width=4, mixtures=3, window=6, stride=3)
    model = Model.fresh(shape, r.integers(1, 9, 20))
    model.params["mix"] *= 40  # weights that have to be kept from overflowing
    steps = [(r.integers(0, 20, (n, 6)), r.integers(0, 20, (n, 6)), r.random((n, 6)) < 0.8) for n in (7, 3)]
    found = []
    for part in (2, 7):
        monkeypatch.setattr(Learner, "PART", part)
        learner = Learner(model)
        for x in steps:
            learner.step(*x)
        found.append((learner.seen, *learner.change()))
    for a, b in zip(*found):
        assert np.isfinite(a).all()
        np.testing.assert_allclose(a, b, rtol=1e-3, atol=1e-4)


def test_first_and_later_windows_are_all_windows():
    lengths = np.array([1, 3, SMALL.window, SMALL.window + 1, 40, 0, 2])
    ids = np.arange(lengths.sum())
    begins = lambda later: [int(a[0]) for at, *_ in Scorer.windows(ids, lengths, 99, SMALL, SMALL.stride, 4, later) for a in at]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0].tolist()
    assert begins(False) == starts and sorted(begins(False) + begins(True)) == sorted(begins(None))
    assert not set(begins(True)) & set(starts)
