"""Exact centroid clustering (Lloyd's rounds on integer vectors) with geometric drift tightening.

Every vector keeps an upper bound of the distance to its own centroid and one lower bound of the distance to all others.
When the centroids move, the upper bound grows by the own centroid's drift.  The lower bound need not shrink by the whole
drift of another centroid: all vectors of a cluster lie in a sphere around its centroid, and how much nearer a moved centroid can
come to any point of that sphere is a question in the plane of the sphere's centre and the two places of the centroid
(``loosening``).  Vectors whose bounds still overlap are measured exactly, in integers; all others keep their cluster.

Vectors travel in blocks of numpy arrays.  A round reads the blocks with their bounds, writes them with new bounds to the
shared folder, and sends for each task only what changed: sums and counts of the vectors that moved between clusters, and
the radius of each sphere.  These are added up in lanes, so the driver gets a bounded number of rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Vectors in a block, and lanes in which the tasks' sums are added up.
BLOCK, LANES = 4096, 64
BLOCKS = "known binary, ids binary, wide boolean, vectors binary, state binary, lane int, moved string"
CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
LONG = (1 << 63) - 1
#: A bound must win by so much before it is trusted: absolute and relative, far above the rounding of doubles.
MARGIN, RELATIVE = 1e-6, 1e-9


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """Upper bound of |x - old| - |x - new| over the points x of a sphere.

    In the plane of ``centre`` and the line from ``old`` to ``new``, with these two at -1 and 1 of the x axis, the points
    where the difference exceeds 2 a lie inside a branch of a hyperbola, and so inside the wedge of its asymptotes, whose
    half angle is arccos(a).  A sphere seen from the origin at the angle phi, with half width asin(radius / distance),
    leaves out every wedge narrower than phi - asin(radius / distance).
    """
    drift = float(np.linalg.norm(new - old))
    if not drift or not math.isfinite(drift):
        return drift
    half = drift / 2
    away = centre - (old + new) / 2
    along = float(away @ (new - old)) / drift
    x, y = along / half, math.sqrt(max(float(away @ away) - along * along, 0.0)) / half
    r, rho = radius / half * (1 + RELATIVE) + RELATIVE, math.hypot(x, y)
    if not r < rho or (x > 0 and r >= y):
        return drift
    cosine = (x * math.sqrt(rho * rho - r * r) + y * r) / (rho * rho)
    return drift * min(max(cosine + RELATIVE, 0.0), 1.0)


def as_float(rows: list[list[int]]) -> np.ndarray:
    """Integers as doubles; those beyond the range of doubles become infinite."""
    def one(v):
        try:
            return float(v)
        except OverflowError:
            return math.copysign(math.inf, v)
    return np.array([[one(v) for v in row] for row in rows])


class Centroids:
    """The centroids of a round, and how far the bounds of each cluster give way since the round before."""

    def __init__(self, places: list[list[int]], before: "Centroids | None" = None, radii: list[float] = ()):
        self.places = places
        self.floats = as_float(places)
        self.top = max((abs(v) for row in places for v in row), default=0)
        k = len(places)
        with np.errstate(all="ignore"):
            apart = np.sqrt(((self.floats[:, None] - self.floats[None]) ** 2).sum(2))
            apart[np.arange(k), np.arange(k)] = np.inf
            self.half = np.nan_to_num(apart.min(1, initial=np.inf) / 2, nan=0.0, posinf=np.inf)
            self.drift, self.loosen = np.zeros(k), np.zeros(k)
            if before is not None:
                self.drift = np.nan_to_num(np.linalg.norm(self.floats - before.floats, axis=1), nan=np.inf)
                self.loosen = np.array([max((loosening(before.floats[i], radii[i], before.floats[j], self.floats[j]) for j in range(k) if j != i),
                                            default=0.0) for i in range(k)])
                self.loosen = np.nan_to_num(self.loosen, nan=np.inf, posinf=np.inf)

    def next(self, sums: list[list[int]], counts: list[int], radii: list[float]) -> "Centroids":
        """Means rounded down; a cluster without vectors stays where it is."""
        return Centroids([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, self.places)], self, radii)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows x clusters): as doubles or longs where these are exact, else as Python integers."""
        top = max(self.top, int(np.abs(x).max(initial=0)))
        most = 4 * x.shape[1] * top * top
        if most < 1 << 52:
            c = self.floats
            return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        if most < 1 << 62:
            xs, c = x.astype(np.int64), self.floats.astype(np.int64)
            return np.stack([((xs - row) ** 2).sum(1) for row in c], axis=1)
        xs = [[int(v) for v in row] for row in x.tolist()]
        out = np.empty((len(xs), len(self.places)), object)
        for i, row in enumerate(xs):
            for j, place in enumerate(self.places):
                out[i, j] = sum((a - b) ** 2 for a, b in zip(row, place))
        return out

    def bounded(self, squares: np.ndarray) -> bool:
        return squares.dtype != object


def nearest(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, distance of the second) of each row; ties go to the smaller number."""
    n, k = squares.shape
    if squares.dtype == object:
        return np.array([min(range(k), key=row.__getitem__) for row in squares], np.int32), np.full(n, np.inf), np.full(n, -np.inf)
    cluster = squares.argmin(1)
    best = squares[np.arange(n), cluster]
    others = squares.astype(np.float64)
    others[np.arange(n), cluster] = np.inf
    return cluster.astype(np.int32), np.sqrt(best.astype(np.float64)), np.sqrt(others.min(1))


def sure(upper: np.ndarray, other: np.ndarray) -> np.ndarray:
    return upper * (1 + RELATIVE) + MARGIN < other * (1 - RELATIVE)


def reassign(x: np.ndarray, state: np.ndarray | None, now: Centroids):
    """New state (cluster, upper, lower) of a block and the number of vectors that were measured against all centroids."""
    if state is None:
        cluster, upper, lower = nearest(now.squares(x))
        return cluster, upper, lower, len(x)
    cluster = state["cluster"].copy()
    with np.errstate(invalid="ignore"):
        upper = state["upper"] + now.drift[cluster]
        lower = np.nan_to_num(state["lower"] - now.loosen[cluster], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    limit = np.maximum(lower, now.half[cluster])
    unsure = np.flatnonzero(~sure(upper, limit))
    if len(unsure):
        squares = now.squares(x[unsure])
        if squares.dtype != object:  # the exact distance to the own centroid first
            upper[unsure] = np.sqrt(squares[np.arange(len(unsure)), cluster[unsure]].astype(np.float64))
            still = ~sure(upper[unsure], limit[unsure])
        else:
            still = np.ones(len(unsure), bool)
        unsure, squares = unsure[still], squares[still]
        if len(unsure):
            cluster[unsure], upper[unsure], lower[unsure] = nearest(squares)
    return cluster, upper, lower, len(unsure)


STATE = np.dtype([("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")])


def vectors_of(raw: bytes, wide: bool, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if wide else "<i4").reshape(-1, dims).astype(np.float64)


def block_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> list[list[int]]:
    """Exact componentwise sums by cluster."""
    if len(x) and len(x) * float(np.abs(x).max()) >= 1 << 52:
        return [[sum(int(v) for v in column) for column in x[cluster == c].T.tolist()] for c in range(k)]
    return [x[cluster == c].sum(0).astype(np.int64).tolist() for c in range(k)]


class Moved:
    """What a task tells the driver: sums and counts of vectors that came less those that went, and the spheres' radii."""

    def __init__(self, k: int, dims: int):
        self.sums, self.counts, self.radii, self.inertia, self.scanned = [[0] * dims for _ in range(k)], [0] * k, [0.0] * k, [0] * k, 0

    def add(self, sums, counts, radii, inertia, scanned, sign=1):
        for c, row in enumerate(sums):
            if any(row):
                self.sums[c] = [a + sign * b for a, b in zip(self.sums[c], row)]
        self.counts = [a + sign * int(b) for a, b in zip(self.counts, counts)]
        self.radii = [max(a, float(b)) for a, b in zip(self.radii, radii)]
        self.inertia = [a + b for a, b in zip(self.inertia, inertia)]
        self.scanned += scanned

    def dump(self) -> str:
        return json.dumps([self.sums, self.counts, self.radii, self.inertia, self.scanned])


def packed(table: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """Blocks of the vectors with ``dims`` components, none null or non-finite, as integers floor(scale * x)."""
    def blocks(it):
        for b in it:
            column = b.column(1)
            values = column.values
            offsets = np.asarray(column.offsets).astype(np.int64)
            whole = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(column.is_valid()))
            if not len(whole):
                continue
            at = offsets[whole][:, None] + np.arange(dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * np.asarray(values.fill_null(np.nan), np.float64)[at])
            good = np.isfinite(x).all(1)
            x, whole = x[good], whole[good]
            ids = b.column(0).take(pa.array(whole))
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.fill_null(0), np.int64)
            for i in range(0, len(x), BLOCK):
                part = x[i:i + BLOCK]
                wide = bool(np.abs(part).max() >= 1 << 31)
                yield pa.RecordBatch.from_arrays([
                    pa.array([known[i:i + BLOCK].astype(np.uint8).tobytes()], pa.binary()), pa.array([numbers[i:i + BLOCK].astype("<i8").tobytes()], pa.binary()),
                    pa.array([wide]), pa.array([part.astype("<f8" if wide else "<i4").tobytes()], pa.binary()), pa.array([None], pa.binary()),
                    pa.array([None], pa.int32()), pa.array([None], pa.string())], [c.split()[0] for c in BLOCKS.split(", ")])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(blocks, BLOCKS)


def seeds(blocks: DataFrame, k: int, dims: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>`` (null ids last; equal ids by their components)."""
    def least(it):
        found: list = []
        for b in it:
            for known, ids, wide, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = vectors_of(raw, wide, dims)
                hashes = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if ok else "~" for ok, i in zip(known, np.frombuffer(ids, "<i8").tolist())]
                some = heapq.nsmallest(k, range(len(hashes)), key=lambda i: (hashes[i], x[i].tolist()))
                found = heapq.nsmallest(k, found + [(hashes[i], x[i].tolist()) for i in some])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found]), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["hash", "v"])

    rows = blocks.where("vectors IS NOT NULL").mapInArrow(least, "hash string, v array<double>").orderBy("hash", "v").limit(k).collect()
    return [[int(v) for v in r["v"]] for r in rows]


def assigned(blocks: DataFrame, now: Centroids, k: int, dims: int, last: bool) -> DataFrame:
    """Blocks with their new state, then a row for each task with what moved.  The last round has exact distances."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def rows(it):
        moved = Moved(k, dims)
        for b in it:
            for known, ids, wide, raw, old in zip(*(b.column(i).to_pylist() for i in range(5))):
                x = vectors_of(raw, wide, dims)
                state = None if old is None else np.frombuffer(old, STATE)
                cluster, upper, lower, scanned = reassign(x, state, now)
                radii = np.zeros(k)
                np.maximum.at(radii, cluster, upper)
                inertia, body = [0] * k, None
                if last:
                    squares = now.squares(x)[np.arange(len(x)), cluster]
                    exact = [int(d) for d in squares.tolist()]
                    for c, d in zip(cluster.tolist(), exact):
                        inertia[c] += d
                    body = json.dumps(exact)
                changed = np.arange(len(x)) if state is None else np.flatnonzero(cluster != state["cluster"])
                if state is not None and len(changed):
                    went = state["cluster"][changed]
                    moved.add(block_sums(x[changed], went, k), np.bincount(went, minlength=k), [0.0] * k, [0] * k, 0, sign=-1)
                moved.add(block_sums(x[changed], cluster[changed], k), np.bincount(cluster[changed], minlength=k), radii, inertia, scanned)
                new = np.empty(len(x), STATE)
                new["cluster"], new["upper"], new["lower"] = cluster, upper, lower
                yield pa.RecordBatch.from_arrays([
                    pa.array([known], pa.binary()), pa.array([ids], pa.binary()), pa.array([wide]), pa.array([raw], pa.binary()),
                    pa.array([new.tobytes()], pa.binary()), pa.array([None], pa.int32()), pa.array([body], pa.string())], names)
        lane = TaskContext.get().partitionId() % LANES
        nothing = [pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.bool_()), pa.array([None], pa.binary()), pa.array([None], pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([lane], pa.int32()), pa.array([moved.dump()])], names)

    return blocks.where("vectors IS NOT NULL").mapInArrow(rows, BLOCKS)


def added_up(blocks: DataFrame, k: int, dims: int) -> Moved:
    """The tasks' rows in one: by lanes in tasks, then at most a row for each lane on the driver."""
    def merged(it):
        total = Moved(k, dims)
        for b in it:
            for text in b.column(0).to_pylist():
                total.add(*json.loads(text))
        yield pa.RecordBatch.from_arrays([pa.array([total.dump()])], ["moved"])

    total = Moved(k, dims)
    for r in blocks.where("lane IS NOT NULL").repartition("lane").select("moved").mapInArrow(merged, "moved string").collect():
        total.add(*json.loads(r["moved"]))
    return total


def _write(spark: SparkSession, df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return path, spark.read.schema(BLOCKS).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    """A round's table goes when the next one is stored, so two rounds at most are on disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cluster_vectors(spark: SparkSession, table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE,
                    seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding", trace: list | None = None) -> DataFrame:
    """Columns of ``CLUSTERED`` for every vector with exactly ``dims`` components, none null or non-finite.

    Components become integers floor(scale * x).  The centroids start as the ``k`` vectors (all, if fewer) with the
    smallest sha256 of ``<seed>:<vec_id>``.  Each of ``rounds`` rounds assigns every vector to the nearest centroid (squared distance; ties go to
    the smaller number) and moves every centroid that has vectors to the exact floor of their mean; then the vectors are
    assigned once more.  Rounds that no longer move a centroid are skipped, as they would change nothing.

    ``cluster_inertia`` and ``inertia`` are the sums of ``distance`` (squared) over the cluster and over all vectors;
    ``centroid_sha256`` is of the centroid's integers in decimal, joined by commas.  All are exact for whatever size; a
    distance or sum beyond a long is null.  A vector whose scaled component is beyond a double takes no part.  Null
    and repeated ids give a row each; a null id starts a cluster only if known ids are too few.  Equal vectors share a
    cluster, so a repeated start is an empty cluster that stays.  Empty tables give an empty result.  Other columns are
    not read.  ``trace`` gets the number of vectors measured against all centroids in each round.
    """
    path, blocks = _write(spark, packed(table, dims, scale, id_col, vec_col), "cluster-blocks")
    starts = seeds(blocks, k, dims, seed)
    if not starts:
        return spark.createDataFrame([], CLUSTERED)
    k = len(starts)
    now, sums, counts, still = Centroids(starts), [[0] * dims for _ in starts], [0] * k, False
    for r in range(rounds + 1):
        last = r == rounds or still
        after, done = _write(spark, assigned(blocks, now, k, dims, last), "cluster-rounds")
        _delete(spark, path)
        path, blocks = after, done
        moved = added_up(blocks, k, dims)
        if trace is not None:
            trace.append(moved.scanned)
        if last:
            break
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, moved.sums)]
        counts = [a + b for a, b in zip(counts, moved.counts)]
        after = now.next(sums, counts, moved.radii)
        still = after.places == now.places
        now = after
    fits = [x if x <= LONG else None for x in moved.inertia]
    total = sum(moved.inertia)
    total = total if total <= LONG else None
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in now.places]
    longest = LONG

    def rows(it):
        for b in it:
            for known, ids, state, exact in zip(*(b.column(i).to_pylist() for i in range(4))):
                cluster = np.frombuffer(state, STATE)["cluster"]
                of = cluster.tolist()
                numbers = [i if ok else None for ok, i in zip(known, np.frombuffer(ids, "<i8").tolist())]
                distances = [d if d <= longest else None for d in json.loads(exact)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(numbers, pa.int64()), pa.array(cluster), pa.array(distances, pa.int64()), pa.array([fits[c] for c in of], pa.int64()),
                    pa.array([total] * len(of), pa.int64()), pa.array([digests[c] for c in of])], [c.split()[0] for c in CLUSTERED.split(", ")])

    return blocks.where("vectors IS NOT NULL").select("known", "ids", "state", "moved").mapInArrow(rows, CLUSTERED)
