"""Similarity-series and metric files (S4 source; K1, K2, K3 sinks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import series_json

GROUPS = ("all_model", "encoder", "fc_layer")


def write_similarity_json(long: DataFrame, path: str, key: str = "pair", grp: str = "grp", idx: str = "idx", value: str = "similarity") -> None:
    """K2: ``{"a-b": {"all_model": [...], "encoder": [...], "fc_layer": [...]}, ...}``, series in order of ``idx``.

    A folder of files whose texts in order of their names are the one object; Spark's committer makes it visible as a whole.
    """
    series_json.document(long, GROUPS, key, grp, idx, value).write.mode("overwrite").text(path)


def read_similarity_json(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Nested similarity JSON -> long ``(pair, grp, idx, similarity)``; NaN tokens allowed.

    One object over a file or a folder of files, or an object on each line; all are read in many splits, so ``wholetext``
    makes no difference.
    """
    return series_json.read(spark, path)


def write_wide_csv(long: DataFrame, path: str, params: Sequence[str], key_cols: Sequence[str] = ("pair", "phase"),
                   step: str = "step", param: str = "param", value: str = "similarity") -> None:
    """K1: one CSV per (pair, phase) with one column per parameter and one row per step.

    The pivot values are passed in (the model's parameter names), so no extra job
    discovers them; files are written once, not rewritten every step.
    """
    wide = long.groupBy(*key_cols, step).pivot(param, list(params)).agg(F.first(value))
    wide.write.mode("overwrite").partitionBy(*key_cols).option("header", True).csv(path)


def read_wide_csv(spark: SparkSession, path: str, params: Sequence[str], step: str = "step",
                  param: str = "param", value: str = "similarity") -> DataFrame:
    """Read K1 output back into long form."""
    schema = ", ".join([f"{step} INT"] + [f"`{p}` DOUBLE" for p in params])
    df = spark.read.schema(schema).option("header", True).option("basePath", path).csv(path)
    keys = [c for c in df.columns if c not in params]
    return df.unpivot(keys, [F.col(f"`{p}`").alias(p) for p in params], param, value)


def metric_scalars(metrics: DataFrame) -> DataFrame:
    """K3: TensorBoard-style scalars ``(run, tag, step, value)`` with ``step = epoch + 1``."""
    phase = F.when(F.col("split") == "train", F.lit("Training")).otherwise(F.lit("Validation"))
    tag = F.concat(phase, F.lit(" "), F.col("name"), F.lit("_"), F.col("task"))
    return metrics.select("run", tag.alias("tag"), (F.col("epoch") + 1).cast("long").alias("step"), "value")


def write_metric_scalars(metrics: DataFrame, path: str) -> None:
    metric_scalars(metrics).write.mode("overwrite").partitionBy("run").parquet(path)
