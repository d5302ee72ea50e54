"""Corpus-level relational operators: projection, NULL handling, unions, joins,
filters and the count aggregates used to size and balance tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("tweet", "emotion", "emotion_ind", "task")


def canonical_projection(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Keep exactly ``tweet, emotion, emotion_ind, task`` (plus ``extra`` keys)."""
    return df.select(*extra, *CANONICAL)


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row when any (selected) column is NULL or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name (duplicates kept)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def join_inner_id(text: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Inner equi-join of text and gold labels on ``key``; duplicate keys multiply."""
    return text.join(labels, key, "inner")


def label_hierarchy(a: DataFrame, b: DataFrame, c: DataFrame, key: str = "id") -> DataFrame:
    """Level A left-join B left-join C on ``key`` with a validity flag.

    Inputs are ``(key, off_label)`` tables.  Output: ``key, label_a, label_b, label_c, valid``.
    Labels of B/C whose id is absent from A are reported by ``hierarchy_orphans``.
    """
    j = (a.select(key, F.col("off_label").alias("label_a"))
         .join(b.select(key, F.col("off_label").alias("label_b")), key, "left")
         .join(c.select(key, F.col("off_label").alias("label_c")), key, "left"))
    ok = ((F.col("label_a") == "NOT") & F.col("label_b").isNull() & F.col("label_c").isNull()) | \
         ((F.col("label_a") == "OFF") & (F.col("label_b") == "UNT") & F.col("label_c").isNull()) | \
         ((F.col("label_a") == "OFF") & (F.col("label_b") == "TIN") & F.col("label_c").isin("IND", "GRP", "OTH"))
    return j.withColumn("valid", F.coalesce(ok, F.lit(False)))


def hierarchy_orphans(a: DataFrame, lower: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a lower level whose id has no level-A label (left anti join)."""
    return lower.join(a.select(key), key, "left_anti")


def filter_task(df: DataFrame, task: str) -> DataFrame:
    """rows of one task; ``meta_all`` keeps everything."""
    return df if task == "meta_all" else df.where(F.col("task") == task)


def task_list(spark, spec: str) -> DataFrame:
    """F2 helper: ``a&b&c`` -> small table ``(task, ord)`` keeping list order."""
    names = spec.split("&")
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "task string, ord int")


def filter_task_list(df: DataFrame, spec: str) -> DataFrame:
    """keep rows of the listed tasks and attach their list position ``ord``.

    The task list is a parameter-sized table (one row per listed task) and is
    broadcast; the corpus is never shuffled for it.
    """
    tl = task_list(df.sparkSession, spec)
    return df.join(F.broadcast(tl), "task", "inner")


# ---- count aggregates --------------------------------------------------------

def value_counts(df: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """A1: row counts by task, by emotion and by emotion_ind within a task.

    One scan with GROUPING SETS.  Output: ``*keys, level, task, emotion,
    emotion_ind, n``; NULL group values are excluded like ``value_counts``.
    """
    keys = list(keys)
    g = df.groupingSets([[*keys, "task"], [*keys, "emotion"], [*keys, "task", "emotion_ind"]],
                        *keys, "task", "emotion", "emotion_ind")
    out = g.agg(F.count(F.lit(1)).alias("n"),
                F.grouping("task").alias("g_task"), F.grouping("emotion").alias("g_emotion"),
                F.grouping("emotion_ind").alias("g_ind"))
    level = (F.when(F.col("g_emotion") == 0, "emotion")
             .when(F.col("g_ind") == 0, "task_emotion_ind").otherwise("task"))
    out = out.withColumn("level", level)
    keep = (((F.col("level") == "task") & F.col("task").isNotNull())
            | ((F.col("level") == "emotion") & F.col("emotion").isNotNull())
            | ((F.col("level") == "task_emotion_ind") & F.col("task").isNotNull()
               & F.col("emotion_ind").isNotNull()))
    out = out.where(keep)
    # descending like value_counts, ties by key; the window runs over the small count table
    order = Window.partitionBy(*keys, "level").orderBy(F.col("n").desc(), "task", "emotion", "emotion_ind")
    return out.select(*keys, "level", "task", "emotion", "emotion_ind", "n",
                      F.row_number().over(order).alias("rank"))


def class_cardinality(df: DataFrame) -> DataFrame:
    """A2: distinct non-NULL classes per task (= output size of the task's head)."""
    return df.groupBy("task").agg(F.count_distinct("emotion_ind").alias("num_class"))


def task_sizes(df: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("n"))


def min_group_size(df: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """A3: smallest task size per key (two-level aggregate)."""
    return task_sizes(df, keys).groupBy(*keys).agg(F.min("n").alias("min_n"))


def batch_counts(df: DataFrame, batch_size: int, keys: Sequence[str] = ("split",)) -> DataFrame:
    """A4: ``ceil(n/B)`` batches per task, with the min, max and total over tasks.

    The window runs over the per-task aggregate (one row per task), not over rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    sizes = task_sizes(df, keys).withColumn("n_batches", F.ceil(F.col("n") / F.lit(batch_size)))
    return sizes.select(*keys, "task", "n", "n_batches",
                        F.min("n_batches").over(w).alias("min_batches"),
                        F.max("n_batches").over(w).alias("max_batches"),
                        F.sum("n_batches").over(w).alias("total_batches"))
