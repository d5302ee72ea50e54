"""Evaluation metrics (A5-A8) and best-epoch tracking.

All metrics are two-level aggregates (partial aggregation, small results).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy_micro(scored: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """A5: ``sum(pred == y) / count`` per key."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pred") == F.col("emotion_ind")).cast("double")).alias("accuracy"))


def loss_batch_mean(scored: DataFrame, keys: Sequence[str] = ("task",), batch: str = "batch") -> DataFrame:
    """Mean over batches of the batch-mean loss (a short last batch weighs the same)."""
    per_batch = scored.groupBy(*keys, batch).agg(F.avg("loss").alias("bl"))
    return per_batch.groupBy(*keys).agg(F.avg("bl").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def task_metrics(scored: DataFrame, keys: Sequence[str] = ("task",), batch: str = "batch") -> DataFrame:
    """A5 + A6 in one two-level aggregate: ``n, accuracy, loss, n_batches`` per key."""
    per_batch = scored.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("__n"), F.sum((F.col("pred") == F.col("emotion_ind")).cast("long")).alias("__ok"),
        F.avg("loss").alias("__bl"))
    return per_batch.groupBy(*keys).agg(
        F.sum("__n").alias("n"), (F.sum("__ok") / F.sum("__n")).alias("accuracy"),
        F.avg("__bl").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def accuracy_batch_mean(scored: DataFrame, episode_keys: Sequence[str]) -> DataFrame:
    """Unweighted mean over (task, episode) of per-episode accuracy and loss."""
    per = scored.groupBy(*episode_keys).agg(
        F.avg((F.col("pred") == F.col("emotion_ind")).cast("double")).alias("acc"),
        F.avg("loss").alias("ls"))
    return per.agg(F.count(F.lit(1)).alias("n_episodes"), F.avg("acc").alias("accuracy"),
                   F.avg("ls").alias("loss"))


def macro_task_mean(per_task: DataFrame, cols: Sequence[str] = ("accuracy", "loss"),
                    keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over tasks of per-task metrics."""
    aggs = [F.avg(c).alias(f"macro_{c}") for c in cols]
    return (per_task.groupBy(*keys) if keys else per_task.groupBy()).agg(F.count(F.lit(1)).alias("n_tasks"), *aggs)


# ---- running best (W3/W4) over step-indexed series -----------------------------------

def running_best(series: DataFrame, keys: Sequence[str], idx: str = "idx", value: str = "value",
                 block: int = 4096) -> DataFrame:
    """Rows where ``value`` strictly beats the best so far (best starts at 0).

    Exact and skew-safe: the series is cut into blocks of ``block`` positions; block
    maxima (a small table) are prefix-maxed per series, then each block is scanned
    with a window of its own.  Adds ``prev_best``.  NaN and NULL never win, and never
    count as the best so far (Spark orders NaN above all numbers).
    """
    keys = list(keys)
    s = (series.withColumn("__blk", F.floor(F.col(idx) / block))
         .withColumn("__v", F.when(~F.isnan(F.col(value)), F.col(value))))
    bmax = s.groupBy(*keys, "__blk").agg(F.max("__v").alias("__bm"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = bmax.select(*keys, "__blk", F.max("__bm").over(before).alias("__pre"))
    inner = Window.partitionBy(*keys, "__blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    j = s.join(prefix, [*keys, "__blk"]).withColumn("__in", F.max("__v").over(inner))
    prev = F.greatest(F.coalesce("__pre", F.lit(0.0)), F.coalesce("__in", F.lit(0.0)), F.lit(0.0))
    return (j.withColumn("prev_best", prev)
             .where(F.col("__v") > F.col("prev_best"))
             .drop("__blk", "__pre", "__in", "__v"))


def best_epoch(series: DataFrame, keys: Sequence[str], idx: str = "idx", value: str = "value") -> DataFrame:
    """First position reaching the maximum; ``(0, 0)`` when nothing beats 0.  NaN and NULL never win."""
    number = F.when(~F.isnan(F.col(value)), F.col(value))
    best = F.max_by(F.col(idx), F.when(number.isNotNull(), F.struct(number, -F.col(idx))))
    g = series.groupBy(*keys).agg(F.max(number).alias("__mx"), best.alias("__at"))
    ok = F.coalesce(F.col("__mx") > 0, F.lit(False))
    return g.select(*keys, F.when(ok, F.col("__at")).otherwise(F.lit(0)).cast("long").alias("best_epoch"),
                    F.when(ok, F.col("__mx")).otherwise(F.lit(0.0)).alias("best_value"))


def epoch_history(metrics: DataFrame, keys: Sequence[str] = ("run", "task", "epoch"),
                  splits: Sequence[str] = ("train", "val"), names: Sequence[str] = ("accuracy", "loss")) -> DataFrame:
    """Long metrics ``(…, split, name, value)`` -> one row per epoch, one column per split/name.

    The pivot values are given explicitly, so no extra job discovers them.
    """
    cols = [f"{s}_{n}" for s in splits for n in names]
    tagged = metrics.withColumn("__col", F.concat_ws("_", "split", "name"))
    return tagged.groupBy(*keys).pivot("__col", cols).agg(F.first("value"))


def history_to_long(wide: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """W5 inverse: wide history back to ``(…, split, name, value)``."""
    long = wide.unpivot(list(keys), list(cols), "__col", "value").where(F.col("value").isNotNull())
    parts = F.split("__col", "_")
    return long.select(*keys, parts[0].alias("split"), parts[1].alias("name"), "value")
