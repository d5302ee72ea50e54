"""Language-model scores of documents: a causal self-attention model over subwords joined with corpus word counts."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import Learner, Model, Scorer, Shape, moved, retabled, train
from .byte_bpe import merge
from .common import bounded_sample, stored
from .word_exchange import Numbers, SpacedWords, answers, assembled, by_batch, flatten, gather, joined, pack, pack_ints, pack_many, unpack_ints, unpack_many, unpack_strings

#: Training documents that give the attention its starting values (those with the smallest hashes), and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 24
#: From there it learns in tasks from the whole training corpus; one of so many batches of windows is a gradient step (1: all).
LEARN_EVERY = 1
#: Share of the spelled word in a word's probability, and what is taken off each word's count for it.
SHARE, DISCOUNT = 0.1, 0.75
#: Words of so many bytes are merged with a heap, whose time doesn't grow with the square of the length.
LONG = 400
#: Subwords whose expected counts travel together.
BLOCK = 512
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Subwords:
    """Word -> subword ids, the space before it included, so that the first one tells that a word begins.

    ``shared`` is a broadcast of {"ranks": ranks}; a worker keeps its value, and with it the library's encoder.
    """

    def __init__(self, shared):
        import tiktoken
        kept = shared.value
        if "encoder" not in kept:
            kept["encoder"] = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=kept["ranks"], special_tokens={})
        self.encode, self.ranks = kept["encoder"].encode_ordinary, kept["ranks"]

    def __call__(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode()) if len(word) < LONG else merge(b" " + word, self.ranks)


def training_windows(docs: DataFrame, n_train: int, shared, end: int, shape: Shape, n_docs: int, n_windows: int) -> np.ndarray:
    """Windows of a bounded sample of training documents: up to ``n_windows`` of each, chosen by hash of their place."""
    def cut(it):
        known: dict[bytes, list[int]] = {}
        subwords = Subwords(shared)
        for b in it:
            for text in b.column(0).to_pylist():
                ids = [end]
                for w in (text or "").encode().lower().split():
                    if w not in known:
                        known[w] = subwords(w)
                    ids += known[w]
                ids.append(end)
                places = sorted(range(0, len(ids), shape.window), key=lambda p: xxhash.xxh64_intdigest(f"{len(ids)}:{p}"))[:n_windows]
                for p in places:
                    p = max(0, min(p, len(ids) - shape.window - 1))
                    row = ids[p:p + shape.window + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([row + [end] * (shape.window + 1 - len(row))], pa.list_(pa.int32()))], ["ids"])

    sample = bounded_sample(docs.where("mark = 0"), n_train, n_docs, "doc_id", "text").select("text")
    found = sample.mapInArrow(cut, "ids array<int>").collect()
    return np.array([r["ids"] for r in found], np.int64).reshape(-1, shape.window + 1)


def spelled(head, found, end: int):
    """Slices of a batch's documents: first and end document, first word, end word, word numbers (ends included), whether
    each is a word, number of subwords of each, the subwords one after the other, and by word number the training counts and
    the first subwords."""
    fields = [unpack_many(a) for a in found]
    none = [np.empty(0, np.uint32)]
    column = lambda i, kind=np.int64: np.concatenate(none + [unpack_ints(f[i]) for f in fields]).astype(kind)
    order = head.order()
    seen, start = (np.empty(len(order) + 1, np.int64) for _ in range(2))
    count = np.empty(len(order) + 1, np.int32)
    sizes = column(2)
    seen[order], count[order], start[order] = column(0) + (column(1) << 32), sizes, np.cumsum(sizes) - sizes
    flat = np.append(column(3, np.int32), np.int32(end))  # short ones, which are fetched at random
    seen[-1], count[-1], start[-1] = 0, 1, len(flat) - 1  # the end is the last word number
    begin = flat[start]
    for i, j, a, b in head.slices(100_000):
        word_ends = np.cumsum(head.lengths[i:j] + 1) - 1
        words = np.full(b - a + j - i, len(order), np.int64)
        is_word = np.ones(len(words), bool)
        is_word[word_ends] = False
        words[is_word] = head.numbers[a:b]
        per_word = count.take(words).astype(np.int64)
        yield i, j, words, is_word, per_word, flat.take(gather(start.take(words), per_word)).astype(np.int64), (seen, begin)


def learnt(packed: DataFrame, back: DataFrame, model: Model, end: int, size: int, every: int, counts: np.ndarray) -> Model:
    """The model after one pass over all training documents, in tasks.

    Every subword adds to the expected counts of the mixtures, from which the tables follow, and every window (of one of
    ``every`` batches, if that isn't 1) to a step of the task's own gradient descent from ``model`` on; the tasks' changes are
    averaged by what they have seen.
    Each task's sums are dealt by blocks of subwords; block -1 holds the matrices.
    """
    spark = packed.sparkSession
    shape = model.shape
    shared = spark.sparkContext.broadcast((model.params, model.table))
    k, d = shape.mixtures, shape.width
    columns = "block int, body binary"

    def gathered(it):
        learner = Learner(Model(shape, *shared.value))
        batches = itertools.count()

        def add(head, found):
            for i, j, _, _, per_word, ids, _ in spelled(head, found, end):
                doc_starts = np.cumsum(head.lengths[i:j] + 1) - head.lengths[i:j] - 1
                lengths = np.add.reduceat(per_word, doc_starts)
                training = head.marks[i:j] == 0
                ids, lengths = ids[np.repeat(training, lengths)], lengths[training]
                for at, before, inside, _ in Scorer.windows(ids, lengths, end, shape, shape.window, shape.batch):
                    learner.step(before, ids[at], inside, next(batches) % every == 0)
            return ()

        for _ in joined(it, add):
            pass
        seen, (met, vectors, dense) = learner.seen, learner.change()
        rows = [(-1, pack_many(np.array([learner.steps], "<f8").tobytes(), dense.astype("<f8").tobytes()))] if learner.steps else []
        for b in range(0, size, BLOCK):
            at = np.flatnonzero(seen[b:b + BLOCK].any(1) | (met[b:b + BLOCK] > 0))
            if len(at):
                body = np.concatenate([seen[b + at], met[b + at, None], vectors[b + at]], axis=1)
                rows.append((b, pack_many(at.astype("<i8").tobytes(), body.astype("<f4").tobytes())))
        for b, body in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([body], pa.binary())], ["block", "body"])

    def summed(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, values = unpack_many(body)
                if block < 0:
                    own = np.concatenate([np.frombuffer(first, "<f8"), np.frombuffer(values, "<f8")])
                    total[block] = total.get(block, 0) + own
                else:
                    at = np.frombuffer(first, "<i8")
                    total.setdefault(block, np.zeros((BLOCK, k + 1 + d)))[at] += np.frombuffer(values, "<f4").reshape(len(at), -1)
        for block, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.astype("<f8").tobytes()], pa.binary())], ["block", "body"])

    out = np.zeros((-(-size // BLOCK) * BLOCK, k + 1 + d))
    steps, dense = 0.0, np.zeros(0)
    for r in by_batch(packed, back).mapInArrow(gathered, columns).repartition("block").mapInArrow(summed, columns).collect():
        values = np.frombuffer(r["body"], "<f8")  # a row for each entry of the vocabulary, in blocks, and the matrices
        if r["block"] < 0:
            steps, dense = values[0], values[1:]
        else:
            out[r["block"]:r["block"] + BLOCK] = values.reshape(BLOCK, -1)
    shared.unpersist()
    out = out[:size]
    if steps:
        model = moved(model, out[:, k], out[:, k + 1:], dense, steps)
    return retabled(model, out[:, :k], counts)


def score_documents(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
                    shape: Shape = Shape(), share: float = SHARE, discount: float = DISCOUNT, sample_docs: int = SAMPLE_DOCS,
                    sample_windows: int = SAMPLE_WINDOWS, learn_every: int = LEARN_EVERY) -> DataFrame:
    """Scores of every whole text (columns of ``SCORED``), a row for each input row.

    Tokens are the words (A-Z lower-cased) and one end.  Training documents are those whose crc32(doc_id as text) mod 5
    is not 1.  With c the count of a token in all training documents, N the sum of the counts and V their number:
    ``base_score`` = sum of log10((c + 0.5) / (N + 0.5 (V + 1))), and ``score`` = sum of log10 P(token), where
    P = A(first) ((1 - share) max(c - discount, 0) / C + (share + (1 - share) discount D / C) A(rest)).  A(first) is the
    probability that the attention model gives the word's first subword after all words before it, given that a word
    begins; A(rest) that of its other subwords, and that no further one follows.  C is the sum of the counts of all words
    with this first subword and D their number: counts say which word it is, the attention what it begins with and how
    unknown words go on.
    So P sums to one over all words.  Counts of words and subwords cover all training documents (a global distinct-word
    shuffle, see ``word_exchange``).  The attention starts from weights trained on the driver, on at most ``sample_docs`` *
    ``sample_windows`` windows, and learns in tasks from every window of every training document (``learn_every`` 1; else one of so
    many batches of windows); what the mixtures say of the next subword is gathered from every subword of every training
    document in the same pass (``learnt``).
    Whole texts are scored in overlapping windows, each subword once.

    Nulls: a null text is empty (its end is scored), a null doc_id counts as the empty text and so as training.  Repeated
    rows are scored and counted each.  An empty table gives an empty result; without training documents all words are
    unknown and the subword tables even.
    """
    size = max(ranks.values()) + 2
    end = size - 1
    shared = spark.sparkContext.broadcast({"ranks": ranks})
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.cast("int").alias("mark"), F.col(text_col).cast("string").alias("text"))
    packed, n_parts = pack(spark, narrow, SpacedWords, "lm-words", count_words=True)

    def answer(parts):
        subwords = Subwords(shared)
        rows = [(batch, part, words, unpack_ints(seen)) for batch, part, (words, seen) in parts]
        numbers = Numbers()
        of_row = [np.fromiter(map(numbers.__getitem__, unpack_strings(w)), np.int64) for _, _, w, _ in rows]
        counts = np.zeros(len(numbers), np.int64)
        for at, (*_, seen) in zip(of_row, rows):
            counts[at] += seen
        known = [subwords(w) for w in numbers]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat = flatten(known).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        for at, (batch, part, _, _) in zip(of_row, rows):
            yield batch, part, pack_many(pack_ints(np.minimum(counts[at], 0xFFFFFFFF)), pack_ints(counts[at] >> 32), pack_ints(lengths[at]),
                                         pack_ints(flat[gather(starts[at], lengths[at])]))
        if rows:  # the sums of this task by subword id: all subwords, then words and distinct words by first subword
            begin = flat[starts]
            sums = [np.bincount(flat, weights=np.repeat(counts, lengths), minlength=size), np.bincount(begin, weights=counts, minlength=size),
                    np.bincount(begin, weights=counts > 0, minlength=size)]
            yield -1, 0, np.concatenate(sums).astype("<i8").tobytes()

    back = stored(spark, answers(packed, n_parts, answer), "lm-answers")

    def sums(it):
        total = np.zeros(3 * size, np.int64)
        for b in it:
            for body in b.column(0).to_pylist():
                total += np.frombuffer(body, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    summed = back.where("batch < 0").select("body").mapInArrow(sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    totals = np.zeros(3 * size, np.int64)
    for r in summed.collect():  # at most three rows for each entry of the vocabulary
        totals[r["id"]] = r["n"]
    counts, begun, kinds = totals.reshape(3, size)
    n_train = narrow.where("mark = 0").count()
    counts[end] = begun[end] = n_train
    kinds[end] = n_train > 0
    n, v = int(begun.sum()), int(kinds.sum())
    model = train(training_windows(narrow, n_train, shared, end, shape, sample_docs, sample_windows), counts, shape)
    begins = np.array([i for token, i in ranks.items() if token[:1] == b" "] + [end])
    asked = back.where("batch >= 0")
    if n_train:
        model = learnt(packed, asked, model, end, size, learn_every, counts)
    final = spark.sparkContext.broadcast((model.params, model.table))
    with np.errstate(divide="ignore", invalid="ignore"):
        by_count = np.where(begun > 0, (1 - share) / begun, 0.0)           # of a word's discounted count, by first subword
        by_spelling = np.where(begun > 0, share + (1 - share) * discount * kinds / begun, 1.0)
    tables = spark.sparkContext.broadcast((by_count, by_spelling))

    def assemble(head, found):
        scorer = Scorer(Model(shape, *final.value), begins)
        of_word = None
        for i, j, words, is_word, per_word, ids, (seen, begin) in spelled(head, found, end):
            if of_word is None:  # of each distinct word of the batch, in a row
                seen[-1] = n_train
                by_count, by_spelling = (t[begin] for t in tables.value)
                with np.errstate(divide="ignore"):
                    by_count, by_spelling = np.log(np.maximum(seen - discount, 0) * by_count), np.log(by_spelling)
                of_word = np.stack([by_count, by_spelling, np.log10((seen + 0.5) / (n + 0.5 * (v + 1))), seen > 0], axis=1)
            by_count, by_spelling, base, known = of_word.take(words, 0).T
            lengths = head.lengths[i:j]
            word_ends = np.cumsum(lengths + 1) - 1
            first = np.cumsum(per_word) - per_word
            doc_starts = word_ends - lengths
            log_p, log_b = scorer.score(ids, np.add.reduceat(per_word, doc_starts), end)
            log_b = log_b[first].astype(np.float64)
            log_first = log_p[first] - log_b
            log_rest = np.add.reduceat(log_p.astype(np.float64), first) - log_p[first]
            log_rest[is_word] += log_b[np.flatnonzero(is_word) + 1]  # a word ends where the next one, or the end, begins
            log_rest += by_spelling
            more, less = np.maximum(by_count, log_rest), np.abs(by_count - log_rest)  # log(exp + exp), where a count of none has -inf
            log_word = log_first + more + np.log(1 + np.exp(-less))
            each = lambda t: np.add.reduceat(t, doc_starts)
            yield pa.RecordBatch.from_arrays([
                pa.array(head.ids[i:j], pa.int64()), pa.array(head.marks[i:j].astype(bool)), pa.array(lengths + 1), pa.array(each(known).astype(np.int64)),
                pa.array(np.full(j - i, n, np.int64)), pa.array(each(base)), pa.array(each(log_word) / np.log(10.0))],
                [x.split()[0] for x in SCORED.split(", ")])

    return assembled(packed, asked, assemble, SCORED)
