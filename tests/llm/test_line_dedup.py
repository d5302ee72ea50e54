import random
from collections import defaultdict

import pytest

from taskweave.llm import line_dedup


def brute(docs, m):
    """Removed line numbers of each document: every run of at least m words that stands earlier, found by comparing all runs."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, docs[i][2]))
    rank = {d: i for i, d in enumerate(order)}
    runs = defaultdict(list)
    for d, (_, text, _) in enumerate(docs):
        every = (text or "").split("\n")
        lines = [(i, tuple(x.encode().split())) for i, x in enumerate(every) if x.encode().split()]
        stops = [*(i - 1 for i, _ in lines[1:]), len(every) - 1]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b][1])
                if n >= m:
                    runs[tuple(x[1] for x in lines[a:b + 1])].append((rank[d], lines[a][0], stops[b], d))
    gone = defaultdict(set)
    for found in runs.values():
        head = min(found)
        for f in found:
            if f != head:
                first = max(f[1], head[2] + 1) if f[3] == head[3] else f[1]
                gone[f[3]].update(range(first, f[2] + 1))
    return gone


def make(seed, n=40):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(14)] + ["", " ", "w " * 12]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 9))) for _ in range(n)]
    for i in range(10, n, 4):
        a, b = texts[r.randrange(i)].split("\n"), texts[i].split("\n")
        s = r.randrange(len(a))
        texts[i] = "\n".join(b[:2] + a[s:s + 4] + [" ".join(b[-1].split()) + "  "] + b[2:])
    return texts


@pytest.mark.parametrize("seed,m", [(1, 6), (2, 10), (3, 14), (4, 1)])
def test_equals_brute_force(spark, seed, m):
    texts = make(seed) + [None, "", "\n \n"]
    ids = list(range(len(texts)))
    ids[5] = None
    df = spark.createDataFrame([(i, t, 1, "x", ["y"]) for i, t in zip(ids, texts)], "doc_id long, text string, removed_lines int, __runs string, copied_from array<string>")
    keys = {(r.doc_id, r.text): r.k for r in df.selectExpr("doc_id", "text", "xxhash64(text) k").collect()}
    gone = brute([(i, t, keys[i, t]) for i, t in zip(ids, texts)], m)
    out = line_dedup.dedup_lines(spark, df, m)
    assert out.columns == df.columns + ["removed_lines_", "copied_from_"]
    got = {(r.doc_id, r.text, r["removed_lines_"]) for r in out.collect()}
    want = {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), len(gone[d])) for d, (i, t) in enumerate(zip(ids, texts))}
    assert got == want and any(gone.values()) and out.count() == len(texts)


def test_windows_cover_every_run():
    r = random.Random(5)
    for _ in range(300):
        words = [r.randint(1, 8) for _ in range(r.randint(0, 12))]
        m = r.randint(1, 12)
        found = line_dedup.windows_of(words, m)
        for a in range(len(words)):
            for b in range(a, len(words)):
                if sum(words[a:b + 1]) >= m:
                    covered = {i for s, e in found if a <= s and e <= b for i in range(s, e + 1)}
                    assert covered == set(range(a, b + 1)), (words, m, a, b)


def test_copies_sources_and_repeated_rows(spark):
    passage = "\n".join(f"line {i} " + "of the passage " * 8 for i in range(3))
    docs = spark.createDataFrame([(9, "own words here\n" + passage), (2, passage), (5, passage + "\n" + passage), (5, passage + "\n" + passage), (1, "other")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.removed_lines, r.copied_from) for r in line_dedup.dedup_lines(spark, docs, 50).collect())
    assert got == [(1, "other", 0, []), (2, passage, 0, []), (5, "", 6, [2]), (5, "", 6, [2]), (9, "own words here", 3, [2])]


def test_empty_table(spark, no_docs):
    assert line_dedup.dedup_lines(spark, no_docs).count() == 0
