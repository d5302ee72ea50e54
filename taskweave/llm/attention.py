"""A small causal self-attention language model over subword ids, in numpy.

One head attends over a window of the last subwords.  What it gathers gives weights over ``mixtures`` distributions of
the next subword, so that a probability costs ``mixtures`` products instead of a sum over the vocabulary:
P(next | window) = sum_k weight_k(window) * table[next, k].  The attention gets starting values by gradients (Adam) on a few
windows, with tables by expectation and maximisation over the same steps (``train``).  From there ``Learner`` goes on in tasks,
each over every window of its own part of the corpus, and the tasks' changes are averaged (``moved``).  The same steps give
each mixture's share in every subword, so that the final tables (``retabled``) are sums over the whole training corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    width: int = 24       # of a subword's vector, and of queries, keys and values
    mixtures: int = 48
    window: int = 24
    stride: int = 20      # new subwords in each window; the others are context
    steps: int = 900
    batch: int = 128      # windows of a training step
    rate: float = 0.01
    smooth: float = 50.0   # weight of the corpus counts in each table, in subwords ...
    floor: float = 0.01    # ... and in the final tables at least this share of the table's own weight
    seed: int = 5

    def __post_init__(self):
        if not 0 < self.stride <= self.window:
            raise ValueError("windows must follow each other without a gap")


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def causal(n: int) -> np.ndarray:
    return np.where(np.tril(np.ones((n, n), bool)), 0, -1e9).astype(np.float32)


def by_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in ascending order, and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    found = ids.take(order)
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    rows = rows.take(order, 0)
    paired = np.result_type(rows, np.complex64) if rows.shape[1] % 2 == 0 else rows.dtype  # two sums in one number
    return found.take(at).astype(np.int64), np.add.reduceat(rows.view(paired), at).view(rows.dtype)


class Model:
    """``params``: embed, place (positions), query, key, value, out, mix, bias; ``table``: next subword x mixture."""

    def __init__(self, shape: Shape, params: dict, table: np.ndarray):
        self.shape, self.params, self.table = shape, params, table

    @classmethod
    def fresh(cls, shape: Shape, counts: np.ndarray) -> Model:
        r, d, k = np.random.default_rng(shape.seed), shape.width, shape.mixtures
        draw = lambda *size, by=1.0: (r.standard_normal(size) * by).astype(np.float32)
        params = {"embed": draw(len(counts), d, by=0.5), "place": draw(shape.window, d, by=0.1), "out": draw(d, d, by=d ** -0.5),
                  "mix": draw(d, k, by=d ** -0.5), "bias": np.zeros(k, np.float32)}
        params |= {name: draw(d, d, by=d ** -0.5) for name in ("query", "key", "value")}
        table = (counts / counts.sum())[:, None] * np.exp(draw(len(counts), k))
        return cls(shape, params, (table / table.sum(0)).astype(np.float32))

    def forward(self, ids: np.ndarray):
        """Windows of ids (n x window) -> mixture weights (n x window x mixtures) and what backward needs."""
        p, d = self.params, self.shape.width
        x = p["embed"][ids] + p["place"][:ids.shape[1]]
        q, k, v = x @ p["query"], x @ p["key"], x @ p["value"]
        a = softmax(q @ k.swapaxes(1, 2) * np.float32(d ** -0.5) + causal(ids.shape[1]))
        c = a @ v
        h = np.tanh(x + c @ p["out"])
        return softmax(h @ p["mix"] + p["bias"]), (x, q, k, v, a, c, h)

    def gradients(self, ids: np.ndarray, weights: np.ndarray, wanted: np.ndarray, kept) -> dict:
        """Of the mean negative log-likelihood; ``wanted``: each mixture's share in the next subword."""
        p, d = self.params, self.shape.width
        x, q, k, v, a, c, h = kept
        n = np.float32(ids.size)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        g = (weights - wanted) / n
        out = {"mix": flat(h).T @ flat(g), "bias": flat(g).sum(0)}
        gh = (g @ p["mix"].T) * (1 - h * h)
        out["out"] = flat(c).T @ flat(gh)
        gc = gh @ p["out"].T
        ga = gc @ v.swapaxes(1, 2)
        gs = a * (ga - (ga * a).sum(-1, keepdims=True)) * np.float32(d ** -0.5)
        gq, gk, gv = gs @ k, gs.swapaxes(1, 2) @ q, a.swapaxes(1, 2) @ gc
        gx = gh + gq @ p["query"].T + gk @ p["key"].T + gv @ p["value"].T
        for name, grad in (("query", gq), ("key", gk), ("value", gv)):
            out[name] = flat(x).T @ flat(grad)
        out["place"] = gx.sum(0)
        out["embed"] = np.zeros_like(p["embed"])
        own, sums = by_id(ids.reshape(-1), flat(gx))
        out["embed"][own] = sums
        return out


def smoothed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts that leave no subword out, and their shares."""
    counts = counts.astype(np.float64) + 0.5
    return counts, counts / counts.sum()


def retabled(model: Model, seen: np.ndarray, counts: np.ndarray) -> Model:
    """The model with tables from ``seen``: each mixture's expected count of each subword in the training corpus."""
    base = smoothed(counts)[1]
    table = seen + np.maximum(model.shape.smooth, model.shape.floor * seen.sum(0)) * base[:, None]
    return Model(model.shape, model.params, (table / table.sum(0)).astype(np.float32))


def train(windows: np.ndarray, counts: np.ndarray, shape: Shape = Shape()) -> Model:
    """``windows``: rows of window + 1 consecutive subword ids; ``counts``: of each id in the whole training corpus."""
    counts, base = smoothed(counts)
    model = Model.fresh(shape, counts)
    if not len(windows):
        model.table[:] = base[:, None]
        return model
    r = np.random.default_rng(shape.seed + 1)
    first = {n: np.zeros_like(v) for n, v in model.params.items()}
    second = {n: np.zeros_like(v) for n, v in model.params.items()}
    seen = model.table.astype(np.float64) * shape.smooth
    order = np.empty(0, np.int64)
    for step in range(1, shape.steps + 1):
        if len(order) < shape.batch:
            order = np.concatenate([order, r.permutation(len(windows))])
        some, order = windows[order[:shape.batch]], order[shape.batch:]
        ids, after = some[:, :-1], some[:, 1:]
        weights, kept = model.forward(ids)
        wanted = weights * model.table[after]
        wanted /= wanted.sum(-1, keepdims=True) + 1e-30
        rate = shape.rate * min(1.0, step / 20, 1.2 * (1 - step / (shape.steps + 1)))
        for name, g in model.gradients(ids, weights, wanted, kept).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            ahead = first[name] / (1 - 0.9 ** step)
            model.params[name] -= np.float32(rate) * ahead / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
        own, shares = by_id(after.reshape(-1), wanted.reshape(-1, shape.mixtures))
        seen[own] += shares
        if step % 10 == 0:
            if step <= shape.steps * 0.7:
                seen *= 0.9  # forget what an early model thought
            table = seen + shape.smooth * base[:, None]
            model.table = (table / table.sum(0)).astype(np.float32)
    return model


class Learner:
    """Gradient steps from a model on: Adam for the small matrices, AdaGrad for the vectors of the subwords that are met.

    ``seen`` holds each mixture's expected count of each subword, gathered in the same steps.  ``change`` gives what the steps
    did to the parameters and how often each subword was met, to be averaged by ``moved``.
    """

    RATE, VECTOR_RATE = 0.003, 0.1
    #: Windows whose arrays are worked on at once (the step is the same for any number).
    PART = 64

    def __init__(self, model: Model):
        self.shape, self.table = model.shape, model.table
        self.embed, self.start_embed = model.params["embed"].copy(), model.params["embed"]
        names = sorted(n for n in model.params if n != "embed")
        self.start = np.concatenate([model.params[n].reshape(-1) for n in names])
        self.dense, self.grad, self.first, self.second = self.start.copy(), *(np.zeros_like(self.start) for _ in range(3))
        self.params, self.grads, at = {}, {}, 0  # views
        for n in names:
            to = at + model.params[n].size
            self.params[n], self.grads[n] = (t[at:to].reshape(model.params[n].shape) for t in (self.dense, self.grad))
            at = to
        size, (w, d, k) = len(self.embed), (self.shape.window, self.shape.width, self.shape.mixtures)
        self.squares = np.full(size, 1e-6, np.float32)
        self.met = np.zeros(size)
        self.seen = np.zeros((size, k))
        self.ids = np.uint16 if size <= 1 << 16 else np.int64  # short ones are sorted by radix
        self.causal = np.tril(np.ones((w, w), np.float32))
        self.ones = np.ones(max(w * self.PART, k), np.float32)  # products with ones sum rows faster than sums do
        self.work = [np.empty((w * self.PART, m), np.float32) for m in (d, 2 * d, w, d, d, k, d, w, 2 * d, d)]
        self.steps = 0

    def step(self, before: np.ndarray, after: np.ndarray, inside: np.ndarray, move: bool = True) -> None:
        """One step on windows (rows x window): the subwords before, the next ones, and which places count.

        Without ``move`` the expected counts are gathered alone.  The windows are gone through in parts whose arrays fit the
        cache of a core; the step is taken on the sum of their gradients.
        """
        p, grads, (d, w) = self.params, self.grads, (self.shape.width, self.shape.window)
        before, after = before.reshape(-1), after.reshape(-1)
        counted = inside.reshape(-1).astype(np.float32)
        query = p["query"] * np.float32(d ** -0.5)
        heads = np.concatenate([query @ p["key"].T, p["value"] @ p["out"]], axis=1)
        wide = np.abs(p["mix"]).sum(0).max() + np.abs(p["bias"]).max() > 60  # else no weight overflows
        bias = np.tile(p["bias"], w)  # a window's, so that fewer and longer rows are added
        wanted = np.empty((len(before), self.shape.mixtures), np.float32)
        gx = np.empty((len(before), d), np.float32)
        joint, size = np.zeros_like(heads), w * self.PART
        self.grad[:] = 0
        for i in range(0, len(before), size):
            at = slice(i, i + size)
            self._part(before[at], after[at], counted[at], heads, bias, wide, wanted[at], gx[at] if move else None, joint)
        own, shares = by_id(after.astype(self.ids), wanted)
        self.seen[own] += shares
        if not move:
            return
        per = np.float32(1 / max(1.0, counted.sum()))
        grads["place"][:] = gx.reshape(-1, w, d).sum(0)
        grads["query"][:] = joint[:, :d] @ p["key"] * np.float32(d ** -0.5)
        grads["key"][:] = joint[:, :d].T @ query
        grads["value"][:] = joint[:, d:] @ p["out"].T
        grads["out"][:] = p["value"].T @ joint[:, d:]
        self.steps += 1
        rate = np.float32(self.RATE * min(1.0, self.steps / 20))
        self.grad *= per
        self.first += 0.1 * (self.grad - self.first)
        self.second += 0.01 * (self.grad * self.grad - self.second)
        self.dense -= rate * (self.first / (1 - 0.9 ** self.steps)) / (np.sqrt(self.second / (1 - 0.99 ** self.steps)) + 1e-8)
        np.add.at(self.met, before, counted.astype(np.float64))
        own, ge = by_id(before.astype(self.ids), gx)
        ge *= per
        squares = self.squares.take(own)
        squares += np.einsum("ij,ij->i", ge, ge) / np.float32(d)
        self.squares[own] = squares
        ge *= (np.float32(self.VECTOR_RATE) / np.sqrt(squares))[:, None]
        self.embed[own] -= ge

    def _part(self, before: np.ndarray, after: np.ndarray, counted: np.ndarray, heads: np.ndarray, bias: np.ndarray, wide: bool, wanted: np.ndarray,
              gx: np.ndarray | None, joint: np.ndarray) -> None:
        """Fills ``wanted``, each mixture's share in the next subwords (zero where none counts), and, unless it is None, ``gx``,
        the gradients of the inputs; adds those of the matrices to ``joint`` (queries and keys, values and what leads out, each
        as one product) and ``self.grads``."""
        p, grads, (d, w) = self.params, self.grads, (self.shape.width, self.shape.window)
        m = len(before)
        x, both, a, c, h, weights, gh, ga, parts, gk = (t[:m] for t in self.work)
        windows = lambda t: t.reshape(-1, w, t.shape[-1])
        self.embed.take(before, 0, out=x, mode="clip")
        x3, both3, a3, ga3, parts3 = map(windows, (x, both, a, ga, parts))
        x3 += p["place"]
        np.matmul(x, heads, out=both)
        q, v = both3[..., :d], both3[..., d:]
        np.matmul(q, x3.swapaxes(1, 2), out=a3)
        np.exp(a.clip(-60, 60, out=a), out=a)
        a3 *= self.causal
        a *= (1 / (a @ self.ones[:w]))[:, None]
        np.matmul(a3, v, out=windows(c))
        np.tanh(np.add(c, x, out=h), out=h)
        np.matmul(h, p["mix"], out=weights)
        by_window = weights.reshape(-1, w * weights.shape[1])
        by_window += bias
        if wide:
            weights.clip(-60, 60, out=weights)
        np.exp(weights, out=weights)
        self.table.take(after, 0, out=wanted, mode="clip")
        wanted *= weights
        in_mix = self.ones[:weights.shape[1]]
        wanted *= (counted / (wanted @ in_mix + np.float32(1e-30)))[:, None]
        if gx is None:
            return
        weights *= (counted / (weights @ in_mix))[:, None]
        weights -= wanted
        grads["mix"] += h.T @ weights
        grads["bias"] += self.ones[:m] @ weights
        np.matmul(weights, p["mix"].T, out=gh)
        h *= h
        gh *= np.subtract(1, h, out=h)
        gh3 = windows(gh)
        np.matmul(gh3, v.swapaxes(1, 2), out=ga3)
        ga -= (np.multiply(gh, c, out=c) @ self.ones[:d])[:, None]
        ga *= a
        np.matmul(ga3, x3, out=parts3[..., :d])
        np.matmul(a3.swapaxes(1, 2), gh3, out=parts3[..., d:])
        np.matmul(parts, heads.T, out=gx)
        gx += gh
        np.matmul(ga3.swapaxes(1, 2), q, out=windows(gk))
        gx += gk
        joint += x.T @ parts

    def change(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times each subword was met, change of its vector times that, change of the matrices times the steps, in one row)."""
        return self.met, (self.embed - self.start_embed) * self.met[:, None], (self.dense - self.start).astype(np.float64) * self.steps


def moved(model: Model, met: np.ndarray, vectors: np.ndarray, dense: np.ndarray, steps: float) -> Model:
    """The model after the tasks' changes: their sums (see ``Learner.change``), averaged by what each task has seen."""
    params = dict(model.params)
    params["embed"] = (params["embed"] + vectors / np.maximum(met, 1)[:, None]).astype(np.float32)
    at = 0
    for name in sorted(n for n in params if n != "embed"):
        size = params[name].size
        params[name] = (params[name] + dense[at:at + size].reshape(params[name].shape) / max(steps, 1)).astype(np.float32)
        at += size
    return Model(model.shape, params, model.table)


class Scorer:
    """Natural logs of the probabilities of subwords, each scored once, in batches of overlapping windows."""

    def __init__(self, model: Model, begins: np.ndarray, batch: int = 64):
        """``begins``: whether a subword can stand first in a word (the end included)."""
        p, s = model.params, model.shape
        self.shape, self.batch = s, batch
        heads = np.concatenate([p["query"] * np.float32(s.width ** -0.5) @ p["key"].T, p["value"] @ p["out"], np.eye(s.width, dtype=np.float32)], axis=1)
        self.of_id, self.of_place = p["embed"] @ heads, p["place"] @ heads  # queries of inputs, values and inputs, as sums
        self.causal = np.tril(np.ones((s.window, s.window), np.float32))
        self.ones = np.ones(s.window, np.float32)  # products sum rows faster than sums do
        self.mix = p["mix"]
        self.wide = np.abs(self.mix).sum(0).max() > 60  # else no weight overflows
        by_bias = np.exp(np.clip(p["bias"], -60, 60))  # the factor of each weight, in the tables once
        self.table = model.table * by_bias
        self.sums = np.stack([by_bias, model.table[begins].sum(0) * by_bias], axis=1).astype(np.float32)

    @staticmethod
    def windows(ids: np.ndarray, lengths: np.ndarray, end: int, shape: Shape, stride: int, batch: int, later: bool | None = None):
        """Batches of windows over documents' subwords: positions, the subwords before them, which are inside the document,
        and the number of each window in it.  ``later``: documents' first windows alone (False) or all others (True)."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts[lengths > 0]] = end
        many = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - shape.window) // stride)), 0)
        doc = np.repeat(np.arange(len(lengths)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        if later is not None:
            doc, nth = (t[(nth > 0) == later] for t in (doc, nth))
        begin, stop = starts[doc] + nth * stride, ends[doc]
        span = np.arange(shape.window)
        for i in range(0, len(begin), batch):
            at = begin[i:i + batch, None] + span
            inside = at < stop[i:i + batch, None]
            np.minimum(at, len(ids) - 1, out=at)
            yield at, before[at], inside, nth[i:i + batch, None]

    def weights(self, ids: np.ndarray, lengths: np.ndarray, end: int, stride: int):
        """Positions of documents' subwords, each once, and their mixture weights (without the bias, and to be divided by their
        sum), batch by batch.  In all but a document's first window only the last ``stride`` places ask."""
        s = self.shape
        d, w = s.width, s.window
        for later, old in ((False, 0), (True, w - stride)):
            x_of, a_of, c_of = (np.empty((self.batch, r, m), np.float32) for r, m in ((w, 3 * d), (w - old, w), (w - old, d)))
            for at, before, inside, _ in self.windows(ids, lengths, end, s, stride, self.batch, later):
                x, a, c = x_of[:len(before)], a_of[:len(before)], c_of[:len(before)]
                self.of_id.take(before, 0, out=x, mode="clip")
                x += self.of_place
                np.matmul(x[:, old:, :d], x[:, :, 2 * d:].swapaxes(1, 2), out=a)
                np.exp(a.clip(-60, 60, out=a), out=a)
                a *= self.causal[old:]
                np.matmul(a, x[:, :, d:2 * d], out=c)
                c *= (1 / (a.reshape(-1, w) @ self.ones)).reshape(len(c), -1, 1)
                c += x[:, old:, 2 * d:]
                new = np.flatnonzero(inside[:, old:])
                h = c.reshape(-1, d).take(new, 0)
                weights = np.tanh(h, out=h) @ self.mix
                if self.wide:
                    weights.clip(-60, 60, out=weights)
                yield at[:, old:].reshape(-1).take(new), np.exp(weights, out=weights)

    def score(self, ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents' subwords, end ids included, one after the other -> log P(subword), log P(some word begins here)."""
        log_p, log_b = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        for to, w in self.weights(ids, lengths, end, self.shape.stride):
            total, begin = (w @ self.sums).T
            log_p[to] = np.log(np.einsum("ij,ij->i", w, self.table.take(ids.take(to), 0)) / total)
            log_b[to] = np.log(begin / total)
        return log_p, log_b
