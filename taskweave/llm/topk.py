"""Exact top-k inner products with a pivot-distance index.

Vectors of integers are lifted by one component so that all have the same length M; then a larger inner product with a
query (lifted by 0) is a smaller Euclidean distance, and the triangle inequality holds.  Every vector belongs to its
nearest pivot; a pivot's vectors, sorted by their distance from it, are cut into annuli (blocks).  A query first searches
the annulus it lies in itself, which bounds the distance of its k-th neighbour, and then every annulus that the bound
reaches: one whose distances from its pivot p lie in [low, high] holds nothing nearer than max(d(q, p) - high, low - d(q, p)).
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stored

#: Pivots, rows from which they are chosen (those with the smallest hashed ids), and rows of an annulus.
PIVOTS, PIVOT_SAMPLE, ANNULUS_ROWS = 32, 1024, 8192
SCALE = 256.0


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec`` (floor of 256 times each component, little-endian int64), without those that take no part."""
    def rows(it):
        for b in it:
            ids, column = b.column(0), b.column(1)
            lists = column.fill_null([]) if column.null_count else column
            offsets, values = np.asarray(lists.offsets), lists.values.cast(pa.float64())
            x = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            alive = (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
            keep = np.flatnonzero(alive)
            whole = np.where(np.isfinite(x), x, 0).astype("<i8")
            out = [whole[i:j].tobytes() for i, j in zip(offsets[keep].tolist(), offsets[keep + 1].tolist())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(out, pa.binary())], ["vec_id", "vec"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return narrow.mapInArrow(rows, "vec_id long, vec binary")


def matrix(column, dim: int) -> np.ndarray:
    """Binary vectors as rows of int64, shorter ones filled with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        a = np.frombuffer(v.as_py() if isinstance(v, pa.Scalar) else v, "<i8")
        out[i, :len(a)] = a
    return out


def lift(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(0.0, square))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    chosen, away = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where every partial sum fits 53 bits."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if top < 2 ** 53:
        return (queries.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return queries @ x.T


def pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: _narrow(a) for k, a in arrays.items()})
    return out.getvalue()


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype == np.int64 and a.size:
        for kind in (np.int16, np.int32):
            if np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max:
                return a.astype(kind)
    return a


def unpack(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k].astype(np.int64) if z[k].dtype.kind == "i" else z[k] for k in z.files}


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, the first of equals."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, -k)[-k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])


def reached(bounds: DataFrame, asking: DataFrame) -> DataFrame:
    """``asker, block``: the annuli (``block, pivot, low, high``) that meet the intervals (``asker, pivot, from, to``).

    Annuli of a pivot follow each other, so those that an interval meets do too.  One sweep over all ends of a pivot, in order,
    counts the annuli below the interval's beginning and those that begin before its end; the numbers between are the
    annuli, so only what is met is listed.
    """
    numbered = bounds.withColumn("number", F.row_number().over(Window.partitionBy("pivot").orderBy("low", "high", "block")) - 1)
    none = F.lit(None).cast("long").alias("asker")
    ends = bounds.select("pivot", none, F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("high").alias("at"), F.lit(2).alias("kind")))))
    asked = asking.select("pivot", "asker", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("to").alias("at"), F.lit(3).alias("kind")))))
    # at equal places: beginnings of intervals, of annuli, ends of annuli, of intervals
    sweep = Window.partitionBy("pivot").orderBy("col.at", "col.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda kind: F.sum((F.col("col.kind") == kind).cast("long")).over(sweep)
    swept = ends.unionByName(asked).select("pivot", "asker", F.col("col.kind").alias("kind"), count(1).alias("begun"), count(2).alias("over")).where("asker IS NOT NULL")
    runs = swept.groupBy("asker", "pivot").agg(F.max(F.when(F.col("kind") == 0, F.col("over"))).alias("first"), F.max(F.when(F.col("kind") == 3, F.col("begun"))).alias("end"))
    met = runs.where("first < end").select("asker", "pivot", F.explode(F.sequence("first", F.col("end") - 1)).alias("number"))
    return met.join(numbered, ["pivot", "number"]).select("asker", "block")


def search(spark: SparkSession, vectors: DataFrame, k: int, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding",
           n_pivots: int = PIVOTS, annulus_rows: int = ANNULUS_ROWS) -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id, rank, vec_id, score`` (all candidates, if fewer).

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but the query's own; ties go to the
    smaller id.  Components are floor(256 x); scores are exact inner products, which must fit a long.  Rows with a null
    id, and vectors that are null or hold null or non-finite components, take no part; shorter vectors count as filled
    with zeros.  Rows that repeat an id are rows of their own.  Empty tables give an empty result.

    Annuli come from a range shuffle on (pivot, distance, id), so a pivot or vector with a third of all rows is cut into
    many.  Only an annulus' bounds meet the bounds of the queries of each annulus (``reached``); the queries
    then travel to the annuli they reach, and each annulus returns at most ``k`` rows a query.  Pivots and the largest
    norm are all that the driver holds.
    """
    own = stored(spark, scaled_vectors(vectors, id_col, vector_col), "topk-vectors")
    n_rows = own.count()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = bounded_sample(own, n_rows, PIVOT_SAMPLE, "vec_id", "vec").collect()
    if not sample:  # equal rows share a hash, so a few distinct rows can all be above the bound
        sample = bounded_sample(own, 0, PIVOT_SAMPLE, "vec_id", "vec").collect()

    def norms(it):
        for b in it:
            x = [np.frombuffer(v, "<i8").astype(np.float64) for v in b.column(1).to_pylist()]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array([max(map(len, x))], pa.int32()), pa.array([max(float(v @ v) for v in x)])], ["dim", "most"])

    dim, most = own.mapInArrow(norms, "dim int, most double").agg(F.max("dim"), F.max("most")).first()
    pivots = far_apart(lift(matrix([r["vec"] for r in sample], dim), most), n_pivots)
    slack = 1e-6 * (1.0 + most ** 0.5)

    def assign(it):
        for b in it:
            if b.num_rows:
                d = distances(lift(matrix(b.column(1), dim), most), pivots)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest]), b.column(0), b.column(1)],
                                                 ["pivot", "distance", "vec_id", "vec"])

    def annuli(it):
        task, serial = TaskContext.get().partitionId(), 0

        def block(pivot, distance, ids, x):
            nonlocal serial
            number = (task << 33) + serial
            serial += 1
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            at = np.flatnonzero(ids % query_every == 0)
            asked = None
            if len(at):
                q = x[at]
                scores = products(q, x)
                kth = []
                for row, self_at in zip(scores, at):
                    others = np.delete(row, self_at)
                    kth.append(np.partition(others, -k)[-k] if len(others) >= k else None)
                square = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64)) + most
                reach = np.array([np.inf if s is None else np.sqrt(max(0.0, n - 2.0 * s)) for s, n in zip(kth, square)])
                away = distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]), pivots)
                asked = (pack(ids=ids[at], x=q, at=at, away=away, reach=reach), away.min(0).tolist(), away.max(0).tolist(), float(reach.max()))
            row = (number, pivot, float(distance.min()), float(distance.max()), pack(ids=ids, x=x), *(asked or (None,) * 4))
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              ["block", "pivot", "low", "high", "body", "queries", "nearest", "farthest", "reach"])

        held: list = []  # rows of one pivot not yet in a block
        for b in it:
            pivot = np.asarray(b.column(0))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]]).tolist()
            for i, j in zip(edges, edges[1:]):
                while i < j:
                    if held and held[0][0] != pivot[i]:
                        yield block(held[0][0], *map(np.concatenate, list(zip(*held))[1:]))
                        held = []
                    room = min(j - i, annulus_rows - sum(len(h[1]) for h in held))
                    s = b.slice(i, room)
                    held.append((int(pivot[i]), np.asarray(s.column(1)), np.asarray(s.column(2)), matrix(s.column(3), dim)))
                    i += room
                    if sum(len(h[1]) for h in held) >= annulus_rows:
                        yield block(held[0][0], *map(np.concatenate, list(zip(*held))[1:]))
                        held = []
        if held:
            yield block(held[0][0], *map(np.concatenate, list(zip(*held))[1:]))

    placed = own.mapInArrow(assign, "pivot int, distance double, vec_id long, vec binary")
    ranged = stored(spark, placed, "topk-placed").repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    index = stored(spark, ranged.mapInArrow(annuli, "block long, pivot int, low double, high double, body binary, queries binary, "
                                                    "nearest array<double>, farthest array<double>, reach double"), "topk-annuli")
    bounds = index.select("block", "pivot", "low", "high")
    asking = (index.where(F.col("queries").isNotNull()).select(F.col("block").alias("asker"), "reach", F.posexplode(F.arrays_zip("nearest", "farthest")))
              .select("asker", "reach", F.col("pos").alias("pivot"), "col.nearest", "col.farthest"))
    wide = F.col("reach") + F.lit(slack)
    visits = reached(bounds, asking.select("asker", "pivot", (F.col("nearest") - wide).alias("from"), (F.col("farthest") + wide).alias("to")))
    sent = visits.join(index.where(F.col("queries").isNotNull()).select(F.col("block").alias("asker"), "queries"), "asker")

    def answer(it):
        block = None
        for b in it:
            for number, asker, pivot, low, high, body in zip(*(c.to_pylist() for c in b.columns)):
                if asker is None:
                    block = (number, pivot, low, high, unpack(body))
                    continue
                number, pivot, low, high, own = block
                q = unpack(body)
                away = q["away"][:, pivot]
                near = np.flatnonzero(np.maximum(away - high, low - away) <= q["reach"] + slack)
                out = []
                for at, scores in zip(near.tolist(), products(q["x"][near], own["x"])):
                    best = top(scores, k + (number == asker))
                    if number == asker:
                        best = best[best != q["at"][at]]
                    out += [(asker, at, int(q["ids"][at]), int(own["ids"][i]), int(scores[i])) for i in best.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["asker", "at", "query_id", "vec_id", "score"])

    none = F.lit(None)
    rows = (index.select("block", none.cast("long").alias("asker"), "pivot", "low", "high", "body")
            .unionByName(sent.select("block", "asker", none.cast("int").alias("pivot"), none.cast("double").alias("low"),
                                     none.cast("double").alias("high"), F.col("queries").alias("body")))
            .repartition("block").sortWithinPartitions("block", F.col("asker").asc_nulls_first()))
    found = rows.mapInArrow(answer, "asker long, at long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asker", "at").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
