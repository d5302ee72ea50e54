"""Prototype classifier operators (A9, V1-V4) on array columns.

* Vector means use ``Summarizer`` -- a JVM aggregate with partial (map-side)
  aggregation -- so rows are never exploded per element.
* A task's head has one row per class; heads are collapsed to one array per
  task before scoring so each scored row joins exactly once, and all per-row
  maths (dot products, argmax, log-sum-exp) are higher-order array functions
  under codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def class_means(rows: DataFrame, keys: Sequence[str], x: str = "x", cls: str = "emotion_ind") -> DataFrame:
    """Mean vector and row count per ``(*keys, cls)``."""
    return (rows.groupBy(*keys, cls)
            .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(x)))).alias("c"),
                 F.count(F.lit(1)).alias("n")))


def prototypes(support: DataFrame, keys: Sequence[str], num_class: DataFrame, x: str = "x",
               drawn: DataFrame | None = None) -> DataFrame:
    """Per ``(*keys, emotion_ind)`` mean of the support vectors.

    Every group of ``drawn`` (all drawn rows, support and query; by default the support
    itself) has all classes ``0..num_class-1`` of its task; an empty class gets a NaN
    vector (mean of nothing), also when the whole group has no support row.
    ``num_class`` is a ``(task, num_class)`` table (A2).  ``keys`` must contain ``task``.
    """
    keys = list(keys)
    means = class_means(support, keys, x)
    groups = (support if drawn is None else drawn).groupBy(*keys).agg(F.max(F.size(x)).alias("__d")).join(num_class, "task")
    spine = groups.select(*keys, "__d", F.explode(F.sequence(F.lit(0), (F.col("num_class") - 1).cast("int")))
                          .alias("emotion_ind"))
    out = spine.join(means, [*keys, "emotion_ind"], "left")
    return out.select(*keys, "emotion_ind", F.coalesce("n", F.lit(0)).alias("n_support"),
                      F.coalesce("c", F.array_repeat(F.lit(float("nan")), F.col("__d"))).alias("c"))


def proto_heads(protos: DataFrame) -> DataFrame:
    """V1: linear head equivalent to nearest-prototype: ``w = 2c``, ``b = -|c|^2``."""
    return protos.withColumn("w", F.transform("c", lambda v: v * 2.0)).withColumn("b", -sq_norm(F.col("c")))


def heads_by_task(heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Collapse class rows into one row per ``keys``: ``heads = array<struct<k, w, b>>`` ordered by k."""
    return (heads.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("emotion_ind").alias("k"), "w", "b"))).alias("heads")))


def score(rows: DataFrame, heads: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """V2-V4: logits, prediction and cross-entropy loss for every row.

    ``heads`` comes from ``heads_by_task`` (one row per task/episode: size is
    classes x dim, independent of the number of scored rows).  Adds ``logits``,
    ``pred`` (first maximal class) and ``loss`` (``logsumexp - logit_y``).
    """
    j = rows.join(heads, list(keys), "inner")
    logits = F.transform("heads", lambda h: dot(h["w"], F.col(x)) + h["b"])
    j = j.withColumn("logits", logits).drop("heads")
    m = F.array_max("logits")
    lse = m + F.log(F.aggregate(F.transform("logits", lambda l: F.exp(l - m)), F.lit(0.0), lambda a, v: a + v))
    return (j.withColumn("pred", (F.array_position("logits", m) - 1).cast("int"))
             .withColumn("loss", lse - F.element_at("logits", F.col("emotion_ind") + 1)))
