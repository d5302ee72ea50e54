import random
from collections import Counter
from itertools import permutations

import numpy as np

from conftest import words
from taskweave.llm import filter_audit as A


def plain_mask(text):
    ws = text.split()  # no other white space in these texts
    return "".join(x for x, fails in zip("ABCD", (
        len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        any(c in "#$%&*|" for c in text))) if fails)


def brute_force(docs, labels):
    """Every filter order run document by document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, part in docs:
        first = least.get(text or "")
        copy = first is not None and (i is None or first < i)
        fails.append((i, part or "", plain_mask(text or "") + ("E" if copy else "")))
    out = {}
    removed_by = Counter()
    for part in {p for _, p, _ in fails}:
        rows = [(i, f) for i, p, f in fails if p == part]
        for order in permutations("ABCDE"):
            alive = rows
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if x in f]
                alive = [(i, f) for i, f in alive if x not in f]
                removed_by[part, x] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == x for _, f in rows),
                    sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def case(spark):
    r = random.Random(5)
    texts = [None, "", " \n ", words(r, 130), words(r, 130, "abcdefghijklmnop"), words(r, 200, "ABCD"), "x " * 120, "A" * 40 + " é" * 90, "one # two"]
    texts += [words(r, r.randint(80, 140), "abcdefghijklmnopqrstuvwxyzABC") + r.choice(["", "", " $5"]) for _ in range(60)]
    texts += texts[:30] + texts[3:5] * 5
    docs = [(None if i in (6, 70) else 9 if i in (10, 11, 80) else i, t, r.choice(["en", "fr", "", None])) for i, t in enumerate(texts)]
    docs += docs[12:15]  # repeated rows
    r.shuffle(docs)
    labels = [(i, r.choice([0, 1, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 120, 2), 9, 9, None]]
    frame = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in docs], "doc_id long, text string, lang string, part int, digest string, mask int, quality string").repartition(3)
    return docs, labels, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order_run_document_by_document(spark):
    docs, labels, frame, marks = case(spark)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in A.COUNTS) for r in A.audit_filters(spark, frame, marks).collect()}
    assert got == brute_force(docs, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in docs})


def test_steps_are_the_first_failed_filter():
    o = A.Orders("ABC")
    for mask in range(8):
        for k, order in enumerate(permutations(range(3))):
            first = [s for s, f in enumerate(order) if mask >> f & 1]
            assert o.steps[mask, k] == (first[0] if first else np.inf)


def test_no_documents_and_no_labels(spark, no_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_filters(spark, no_docs, marks).count() == 0
    one = no_docs.sparkSession.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = A.audit_filters(spark, one, marks).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}
    assert sum(r["removed"] for r in rows) == 120  # filter A, once in every order
