import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from taskweave.llm import simhash_dedup
from taskweave.llm.components import components


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most, depth", [(1, 2), (3, 2), (3, 3), (4, 2), (4, 3), (7, 2)])
def test_links_are_whole(spark, most, depth):
    r = random.Random(most)
    centre = r.getrandbits(64)
    fps = {0, (1 << 64) - 1, centre}
    for _ in range(250):
        x = centre if r.random() < 0.6 else r.choice(sorted(fps))
        for b in r.sample(range(64), r.randint(1, most + 2)):
            x ^= 1 << b
        fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = {(x.a, x.b) for x in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most, depth).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
    assert got == want and want


def test_keys_grow_with_the_number_of_fingerprints():
    assert [simhash_dedup.key_depth(n, 4) for n in (0, 10 ** 6, 10 ** 8, 10 ** 9, 10 ** 11)] == [2, 2, 2, 3, 3]
    segments = simhash_dedup.ring(4)
    assert len(simhash_dedup.flips(0, 2, 4, segments)) == 14 and len(simhash_dedup.flips(2, 2, 4, segments)) == 14
    for mask in simhash_dedup.flips(1, 3, 4, segments):
        (a, w), (b, v) = segments[2], segments[3]
        assert (mask >> a & (1 << w) - 1).bit_count() <= 1 and mask.bit_count() <= 2 and mask >> a << a == mask and mask < 1 << b + v


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(500, 501), (501, 500), (7, 7), (-9, 500), (900, 900)]
    edges += [(r.randint(1000, 1100), r.randint(1000, 1100)) for _ in range(60)]
    got = {x.node: x.root for x in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    r = random.Random(9)
    base = [" ".join(r.choice(["la", "mi", "so", "do", "re", "fa"]) + str(r.randint(0, 99)) for _ in range(200)) for _ in range(4)]
    out = []
    for i in range(40):
        w = base[i % 4].split()
        for _ in range(i // 8):
            w[r.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, texts):
    all_texts = texts + near_texts()
    rows = [(None if i == 4 else i, t, "x", 1.0) for i, t in enumerate(all_texts)] + [(3, texts[3], "x", 1.0), (12, "another text of the same id", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root double")
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    least: dict = {}
    for r, c in zip(rows, roots):
        least[c] = min([x for x in (least.get(c), r[0]) if x is not None], default=None)
    want = Counter((r[0], f"{fp:016x}", least[c]) for r, fp, c in zip(rows, fps, roots))
    assert Counter(tuple(x) for x in simhash_dedup.near_duplicates(spark, docs).collect()) == want
    kept = simhash_dedup.drop_near_duplicates(spark, docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(least[c]) for c in set(roots))
    assert kept[0].__fields__ == docs.columns


def test_empty(spark, no_docs):
    assert simhash_dedup.near_duplicates(spark, no_docs).count() == 0
    assert simhash_dedup.drop_near_duplicates(spark, no_docs).columns == no_docs.columns
