import random
from collections import defaultdict

import numpy as np
import pytest

from conftest import words
from taskweave.llm import suffix_dedup as S


def brute_force(docs, length):
    """(doc_id, bytes, removed, spans, kept) of every document, by all strings of ``length`` bytes."""
    least = {}
    rows = [(S.LAST if i is None else i, i, (t or "").encode()) for i, t in docs]
    for rank, _, b in rows:
        for a in range(len(b) - length + 1):
            g = b[a:a + length]
            least[g] = min(rank, least.get(g, rank))
    out = []
    for rank, i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            if least[b[a:a + length]] < rank:
                gone[a:a + length] = True
        gone[len(b):] = False
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return sorted(out, key=repr)


def corpus(length):
    r = random.Random(length)
    passages = [words(r, 30), words(r, 80), "é" * length, "ab" * length, "x" * (3 * length), "中文字" * 40]
    docs = []
    for i in range(120):
        parts = [words(r, r.randint(0, 40)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts.insert(r.randint(0, len(parts)), p[a:a + r.randint(length // 2, 2 * length)])
        docs.append((i, r.choice(["", " ", "\n", "\0"]).join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(20)]
    docs += [(300, None), (301, ""), (302, "x" * (length - 1)), (303, "x" * length), (None, docs[3][1]), (None, "n" * 200), (5, docs[8][1]), docs[9]]
    docs += [(400, words(r, 3000)), (401, "q" * 4000)]
    docs += [(500 + i, f"{words(r, 5)} {passages[1]} {words(r, 5)}") for i in range(60)]
    r.shuffle(docs)
    return docs


def run(spark, docs, **kw):
    frame = spark.createDataFrame([(i, t, "k", 1, "b") for i, t in docs], "doc_id long, text string, kind string, part int, body string").repartition(5)
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(spark, frame, **kw).collect()], key=repr)


@pytest.mark.parametrize("length, gram", [(50, 24), (20, 9), (33, 33)])
def test_every_string_against_all_others(spark, length, gram):
    docs = corpus(length)
    assert run(spark, docs, length=length, gram=gram) == brute_force(docs, length)


def test_results_do_not_depend_on_batches_parts_or_hot_anchors(spark):
    docs = corpus(50)
    assert run(spark, docs, batch_bytes=3000, part_bytes=2000, hot=4, merge_bytes=500) == brute_force(docs, 50)


def test_no_documents(spark, no_docs):
    assert S.remove_repeats(spark, no_docs).collect() == []


def test_shard_order_and_transform():
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab\xff\0") for _ in range(r.randint(1, 60))) for _ in range(30)] + [b"a" * 50] * 3
    shard = S.Shard(texts, np.arange(1, 257).astype(np.uint16))
    # symbols: ends below all bytes, in the order of their segments; a segment is a ring
    whole = [tuple([len(texts) + c for c in t[a:]] + [k]) for k, t in enumerate(texts) for a in range(len(t) + 1)]
    rings = [[c + 1 for c in t] + [0] for t in texts]
    order = sorted(range(len(whole)), key=whole.__getitem__)
    assert shard.order.tolist() == order
    before = [(ring[a - 1], ring[a - 2]) for ring in rings for a in range(len(ring))]
    assert list(zip(shard.transform.tolist(), shard.before.tolist())) == [before[i] for i in order]


def test_merged_intervals_are_those_of_a_sorted_collection():
    r = random.Random(6)
    for n_shards, length, kinds in ((1, 20, b"ab"), (2, 20, b"ab"), (5, 19, b"a\0\xff"), (3, 12, bytes(range(256)))):
        base = bytes(r.choice(kinds) for _ in range(400))
        texts = list({base[a:a + r.randint(length, 2 * length)] for a in (r.randint(0, 330) for _ in range(60))} | {bytes(range(256))})
        least = np.array([r.randint(0, 30) for _ in texts])
        held = defaultdict(list)
        for t, i in zip(texts, least.tolist()):
            for a in range(len(t) - length + 1):
                held[t[a:a + length]].append(i)
        expected = [min(held[t[a:a + length]]) for t in texts for a in range(len(t) - length + 1)]
        assert S.least_holders(texts, least, length, n_shards).tolist() == expected
