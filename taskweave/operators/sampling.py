"""Deterministic splitting, balancing, batching and episode sampling.

Random generator state cannot be replayed on a cluster, so every shuffle is a
seeded permutation: rows are ordered by ``md5('<seed>:<salt>:<row_id>')`` with the
row id as tie-break.  Sizes, disjointness and stream/cycling semantics follow the
reference exactly.  Ranks come from ``bucketed_rank`` so no task/class group is
ever sorted inside a single task.

Stream closed form (P4/P7): a (task, class) stream of ``n`` rows cut into batches
of ``K`` has ``nb = ceil(n/K)`` batches per pass.  Global draw number ``g`` reads
pass ``floor(g/nb)``, batch ``g mod nb``; each pass is a fresh permutation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import draw_key, hash_rank, within_k_smallest


def split_holdout(df: DataFrame, seed: int = 3, test_size: float = 0.3, by: Sequence[str] = ("task",),
                  row_id: str = "row_id", train: str = "train", holdout: str = "val") -> DataFrame:
    """Per group, exactly ``ceil(test_size*n)`` rows go to ``holdout``, the rest to ``train``.

    Adds column ``split``.
    """
    by = list(by)
    keyed = df.withColumn("__key", draw_key(seed, "split", row_id))
    # k-smallest membership needs no rank for most rows: the corpus itself is never shuffled
    out = within_k_smallest(keyed, by, "__key", row_id,
                            lambda c: c.withColumn("__k", F.ceil(F.col("__tot") * F.lit(test_size))), "__in")
    return out.withColumn("split", F.when(F.col("__in"), holdout).otherwise(train)).drop("__key", "__in")


def balance_min_downsample(df: DataFrame, seed: int = 3, keys: Sequence[str] = ("split",),
                           row_id: str = "row_id") -> DataFrame:
    """Per key, every task is sampled without replacement down to the smallest task size."""
    keys = list(keys)
    keyed = df.withColumn("__key", draw_key(seed, "balance", row_id))
    # k = smallest task size of the key, computed on the small bucket-count table
    smallest = F.min("__tot").over(Window.partitionBy(*keys))
    out = within_k_smallest(keyed, [*keys, "task"], "__key", row_id, lambda c: c.withColumn("__k", smallest), "__in")
    return out.where(F.col("__in")).drop("__key", "__in")


def batch_shuffled(df: DataFrame, batch_size: int, seed: int = 3, epoch: int = 0,
                   by: Sequence[str] = ("task",), row_id: str = "row_id") -> DataFrame:
    """Shuffle each group and cut it into batches of ``batch_size`` (last batch may be short).

    Adds ``batch`` (0-based) and ``pos`` (position inside the batch).
    """
    keyed = df.withColumn("__k", draw_key(seed, F.lit(f"{epoch}:0"), row_id))
    ranked = hash_rank(keyed, list(by), "__k", row_id, "__rk")
    return ranked.select(*[c for c in df.columns],
                         ((F.col("__rk") - 1) / batch_size).cast("long").alias("batch"),
                         ((F.col("__rk") - 1) % batch_size).cast("int").alias("pos"))


def _read_streams(df: DataFrame, streams: DataFrame, by: list[str], batch_size: int, seed: int,
                  salt_prefix: Column | None, row_id: str) -> DataFrame:
    """Rows with the draws that read them: adds ``g`` (global draw number) and ``pos``.

    ``streams`` has one row for each stream (and epoch): ``*by, nb, n_draws`` and further columns, which
    are kept.  No draw is listed anywhere: a row of rank r in a pass belongs to batch ``(r - 1) / K`` of it,
    and pass p, batch b is draw ``g = p * nb + b``; rows whose g is not drawn are dropped.
    Passes of a stream differ only in their hash, so a row is copied once for each pass that is drawn.
    """
    expanded = (df.join(streams, by, "inner")
                .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_draws") - 1) / F.col("nb"))))))
    salt = F.col("pass").cast("string") if salt_prefix is None else \
        F.concat(salt_prefix, F.lit(":"), F.col("pass").cast("string"))
    keyed = expanded.withColumn("__key", draw_key(seed, salt, row_id))
    groups = [*by, *(["epoch"] if salt_prefix is not None else []), "pass"]
    ranked = hash_rank(keyed, groups, "__key", row_id, "__rk")
    return (ranked.withColumn("g", F.col("pass") * F.col("nb") + F.floor((F.col("__rk") - 1) / batch_size))
            .where(F.col("g") < F.col("n_draws"))
            .withColumn("pos", ((F.col("__rk") - 1) % batch_size).cast("int"))
            .drop("__key", "__rk", "pass", "nb", "n_draws"))


def episode_sampler(df: DataFrame, k: int = 10, epochs: int = 1, seed: int = 3,
                    row_id: str = "row_id") -> DataFrame:
    """Few-shot episodes; each episode takes the next K-batch of every (task, class).

    Episodes per epoch ``L = min nb`` over all (task, class) streams; streams persist
    across epochs and reshuffle only when exhausted.  Output adds ``epoch, episode,
    pos`` (position in the class draw) to the input columns.
    """
    by = ["task", "emotion_ind"]
    streams = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(k)).alias("nb"))
    # L over the per-stream aggregate (one row per task x class).
    streams = streams.withColumn("L", F.min("nb").over(Window.partitionBy())).withColumn("n_draws", F.col("L") * epochs)
    drawn = _read_streams(df, streams, by, k, seed, None, row_id)
    return (drawn.withColumn("epoch", F.floor(F.col("g") / F.col("L")).cast("int"))
            .withColumn("episode", (F.col("g") % F.col("L")).cast("int")).drop("g", "L"))


def first_episode(df: DataFrame, k: int = 10, seed: int = 3, row_id: str = "row_id") -> DataFrame:
    """The rows of the first episode of the first epoch only (``epoch, episode`` 0, ``pos``), as ``episode_sampler`` draws them.

    It is the first draw of every stream, so no other row is ranked, copied or moved: each stream's K-th smallest key is
    found and the rows are compared with it.
    """
    by = ["task", "emotion_ind"]
    keyed = df.withColumn("__key", draw_key(seed, "0", row_id))
    drawn = within_k_smallest(keyed, by, "__key", row_id, lambda c: c.withColumn("__k", F.lit(k).cast("long")), "__in").where("__in").drop("__in")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__key", row_id))           # at most k rows each
    return drawn.withColumn("pos", (place - 1).cast("int")).withColumns({"epoch": F.lit(0), "episode": F.lit(0)}).drop("__key")


def support_query(df: DataFrame, group: Sequence[str], pos: str = "pos") -> DataFrame:
    """First ``floor(len/2)`` rows of each draw (by ``pos``) are support, the rest query."""
    cnt = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return df.withColumn("role", F.when(F.col(pos) < F.floor(cnt / 2), "support").otherwise("query"))


def episode_support_query(episodes: DataFrame) -> DataFrame:
    """P5: class-stratified halving of each episode draw."""
    return support_query(episodes, ["epoch", "episode", "task", "emotion_ind"])


def batch_support_query(batches: DataFrame) -> DataFrame:
    """Halving of a whole mixed-class task batch (not stratified)."""
    return support_query(batches, ["epoch", "step", "task"])


SCHEDULES = ("zip_shortest", "min", "mean_max_min")


def multitask_step_schedule(df: DataFrame, batch_size: int, epochs: int = 1, mode: str = "mean_max_min",
                            seed: int = 3, row_id: str = "row_id") -> DataFrame:
    """Align per-task batch streams into steps.

    ``zip_shortest``/``min`` -> ``min nb`` steps; ``mean_max_min`` ->
    ``int((max nb + min nb)/2)`` steps with exhausted tasks cycling through a fresh
    permutation.  Streams restart every epoch.  Output adds ``epoch, step, pos``.
    """
    if mode not in SCHEDULES:
        raise ValueError(f"mode must be one of {SCHEDULES}")
    by = ["task"]
    streams = df.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / F.lit(batch_size)).alias("nb"))
    w = Window.partitionBy()
    lo, hi = F.min("nb").over(w), F.max("nb").over(w)
    steps = lo if mode in ("zip_shortest", "min") else ((hi + lo) / 2).cast("long")
    streams = (streams.withColumn("n_draws", steps)
               .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))))
    drawn = _read_streams(df, streams, by, batch_size, seed, F.col("epoch").cast("string"), row_id)
    return drawn.withColumn("step", F.col("g").cast("int")).drop("g")
