import random

import numpy as np
import pytest

from taskweave.llm import topk


def brute(rows, k, every):
    alive = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(alive):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(alive) if j != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, pivot int, distance string").repartition(3)
    return sorted(tuple(r) for r in topk.search(spark, df, **options).collect())


@pytest.mark.parametrize("annulus_rows,n_pivots", [(16, 4), (1000, 1), (64, 50)])
def test_equals_brute_force(spark, annulus_rows, n_pivots):
    r = np.random.default_rng(n_pivots)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * r.normal(size=8)).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(1000, 1150)]  # one vector very often: ties go to the smaller id
    rows += [(2000, [0.0] * 8), (2010, [1e4] * 8), (3, rows[3][1]), (10, rows[10][1])]  # repeated rows
    rows += [(2020, None), (2030, [None] * 8), (2040, [float("nan")] + [1.0] * 7), (2050, [float("inf")] * 8), (None, [0.1] * 8), (2060, []), (2070, [0.3] * 5)]
    assert search(spark, rows, k=5, query_every=10, annulus_rows=annulus_rows, n_pivots=n_pivots) == brute(rows, 5, 10)


def test_fewer_candidates_than_k_and_none(spark):
    assert search(spark, [(0, [1.0]), (50, [2.0]), (7, [-1.0])], k=5, query_every=50) == [(0, 1, 50, 131072), (0, 2, 7, -65536), (50, 1, 0, 131072), (50, 2, 7, -131072)]
    assert search(spark, [(0, [1.0])], k=5, query_every=50) == []
    assert search(spark, [(0, None)], k=5, query_every=50) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 2.5]), (3, [-3e6, 0.0])]
    assert search(spark, rows, k=3, query_every=4) == brute(rows, 3, 4)


def test_one_vector_repeated_beyond_the_pivot_sample(spark):
    from pyspark.sql import functions as F
    rows = spark.range(3000).select(F.array(*[F.lit(25 / 256)] * 4).alias("embedding"))
    for i in range(50, 1050, 50):  # the first id whose hash is above the bound
        repeated = rows.withColumn("vec_id", F.lit(i).cast("long"))
        own = topk.scaled_vectors(repeated, "vec_id", "embedding")
        if not topk.bounded_sample(own, 3000, topk.PIVOT_SAMPLE, "vec_id", "vec").count():
            break
    else:
        pytest.fail("no case whose thinned sample is empty")
    found = topk.search(spark, repeated, k=2, query_every=50).collect()
    assert len(found) == 6000 and {r.score for r in found} == {4 * 25 * 25}


def test_intervals_meet_annuli(spark):
    r = random.Random(1)
    bounds, number = [], 0
    for pivot in range(4):
        at = 0.0
        for _ in range(r.choice([1, 5, 30])):
            low = at + r.choice([0.0, 0.0, r.random()])
            at = low + r.choice([0.0, r.random()])
            bounds.append((number, pivot, low, at))
            number += 1
    ends = [x for _, _, low, high in bounds for x in (low, high)] + [-1.0, 99.0, float("inf"), float("-inf")]
    asking = [(a, p, *sorted((r.choice(ends), r.choice(ends)))) for a in range(60) for p in range(5)]
    got = topk.reached(spark.createDataFrame(bounds, "block long, pivot int, low double, high double"),
                       spark.createDataFrame(asking, "asker long, pivot int, `from` double, `to` double"))
    want = sorted((a, b) for a, p, x, y in asking for b, q, low, high in bounds if p == q and low <= y and high >= x)
    assert sorted(map(tuple, got.collect())) == want
