"""S3: line files where the line position is the join key.

Spark's text scan keeps lines in order inside a file split, and
``monotonically_increasing_id`` numbers rows consecutively inside a scan
partition.  So the global line number is

    offset(split) + (row id - first row id of the split)

where splits are ordered by ``(file path, block start)``.  Only the per-split
counts (one row per split -- metadata-sized) are prefix-summed; the lines
themselves are never sorted or moved to one task.  This is the two-pass
``zipWithIndex`` scheme expressed with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .delimited import NA_TOKENS


def read_lines_positional(spark: SparkSession, path: str, skip_blank: bool = False, col: str = "line",
                          na_tokens: bool = True) -> DataFrame:
    """Lines of the files under ``path`` with their 0-based global position ``pos``.

    ``skip_blank=True`` drops empty lines before numbering (label files);
    ``skip_blank=False`` keeps them as NULL rows (text files).  With ``na_tokens``
    the pandas missing-value strings become NULL.  No quoting is applied.
    """
    raw = spark.read.text(path)
    if skip_blank:
        raw = raw.where(F.col("value") != "")
    # numbered after the filter, so the ids of one split stay consecutive
    raw = raw.select(
        F.col("value").alias(col),
        F.col("_metadata.file_path").alias("__f"),
        F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"))
    splits = raw.groupBy("__f", "__b").agg(F.min("__m").alias("__m0"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = raw.join(splits.select("__f", "__b", "__m0", "__off"), ["__f", "__b"])
    out = out.select((F.col("__off") + F.col("__m") - F.col("__m0")).alias("pos"), col)
    if na_tokens:
        out = out.withColumn(col, F.when(F.col(col).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(col)))
    return out


def write_lines(df: DataFrame, path: str, order: str, col: str) -> None:
    """Write one line per row, globally ordered by ``order`` (part files follow the order)."""
    df.orderBy(order).select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def join_positional(text: DataFrame, labels: DataFrame) -> DataFrame:
    """Text LEFT JOIN labels on position, then drop rows with any missing value."""
    return text.join(labels, "pos", "left").na.drop("any")
