import hashlib
import math
import random

import numpy as np

from taskweave.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, ids string, state int, moved string"


def brute_force(rows, k, rounds, dims, scale, seed="3"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    places = [v for _, v in first[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(places)), key=lambda c: (square(v, places[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, of) if c == j] for j in range(len(places))]
        places = [[sum(x) // len(g) for x in zip(*g)] if g else p for g, p in zip(groups, places)]
    found = [(i, c, square(v, places[c])) for i, v in kept for c in [near(v)]]
    by = [sum(d for _, c, d in found if c == j) for j in range(len(places))]
    small = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return sorted([(i, c, small(d), small(by[c]), small(sum(by)), digest[c]) for i, c, d in found], key=repr)


def clouds(r, n, dims, spread=0.3):
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [[x + r.gauss(0, spread) for x in r.choice(centres)] for _ in range(n)]


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(4)
    return sorted([tuple(x) for x in C.cluster_vectors(spark, frame, **kw).collect()], key=repr)


def test_all_rounds_against_plain_lloyd(spark):
    r = random.Random(4)
    rows = list(enumerate(clouds(r, 400, 5)))
    rows += [(900, None), (901, [0.1] * 4), (902, [0.1, None, 0.2, 0.3, 0.4]), (903, [math.nan] * 5), (904, [math.inf] * 5), (905, [1.7e308] * 5)]
    rows += [(None, rows[3][1]), (7, rows[9][1]), rows[11]] + [(1000 + i, rows[5][1]) for i in range(200)]
    trace = []
    got = run(spark, rows, k=7, rounds=6, dims=5, scale=64, trace=trace)
    assert got == brute_force(rows, 7, 6, 5, 64)
    assert trace[0] == 603 and sum(trace[1:]) < 0.6 * trace[0] * (len(trace) - 1)  # bounds spare most vectors the scan


def test_ties_repeated_starts_and_few_vectors(spark):
    grid = [(i, [float(i % 4), float(i // 4)]) for i in range(16)]
    assert run(spark, grid, k=5, rounds=4, dims=2, scale=1) == brute_force(grid, 5, 4, 2, 1)
    same = [(i, [0.5, 0.5]) for i in range(9)]
    assert run(spark, same, k=3, rounds=3, dims=2, scale=8) == brute_force(same, 3, 3, 2, 8)
    two = grid[:2]
    assert run(spark, two, k=8, rounds=3, dims=2, scale=8) == brute_force(two, 8, 3, 2, 8)


def test_components_of_every_size(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * 10 ** size for _ in range(3)]) for i in range(60) for size in [r.choice([0, 3, 5])]]
    rows += [(60 + i, [(1 + i / 9) * 1e80, 2e80, -1e80]) for i in range(3)] + [(70 + i, [9e9 + i] * 3) for i in range(4)] + [(80, [1e300, 0.0, 0.0])]
    got = run(spark, rows, k=4, rounds=4, dims=3, scale=1024)
    assert got == brute_force(rows, 4, 4, 3, 1024)
    assert any(x[3] is None for x in got) and any(x[2] for x in got)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.cluster_vectors(spark, none).collect() == []
    assert C.cluster_vectors(spark, spark.createDataFrame([(1, [0.5], "a", 1, "b")], SCHEMA)).schema == none.sparkSession.createDataFrame([], C.CLUSTERED).schema


def test_loosening_bounds_every_point_of_a_sphere_and_is_less_than_the_drift():
    g = np.random.default_rng(1)
    tighter = 0
    for _ in range(400):
        d = int(g.integers(2, 6))
        centre, old = g.normal(size=d) * 3, g.normal(size=d) * 3
        new = old + g.normal(size=d) * g.choice([0.1, 1, 3])
        radius = float(g.uniform(0, 3))
        bound = C.loosening(centre, radius, old, new)
        away = g.normal(size=(500, d))
        x = centre + away / np.linalg.norm(away, axis=1, keepdims=True) * radius * g.uniform(0, 1, size=(500, 1)) ** 0.2
        nearer = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        assert nearer.max() <= bound + 1e-9
        tighter += bound < 0.9 * np.linalg.norm(new - old)
    assert tighter > 100
