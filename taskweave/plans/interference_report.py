"""Interference report -- similarity series per task pair and group, smoothed.

V6 cosines -> sampled every ``every_nth`` steps -> W1 rolling mean -> per series
summary (mean similarity, share of steps with negative similarity, last smoothed
value).  Everything is grouped by ``(pair, grp)``; the rolling mean uses halo
blocks, so no series is sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interference as I
from ..operators import windows as W


def similarity_series(grads: DataFrame, order: DataFrame, every_nth: int = 10) -> DataFrame:
    """V6 on sampled steps with the series position ``idx = step / every_nth``."""
    sampled = I.filter_every_nth(grads, every_nth)
    sims = I.group_cosines(sampled, I.task_pairs(order))
    return sims.withColumn("idx", (F.col("step") / every_nth).cast("long"))


def interference_report(grads: DataFrame, order: DataFrame, every_nth: int = 10, window: int = 20) -> DataFrame:
    series = similarity_series(grads, order, every_nth)
    rolled = W.rolling_mean(series, ["pair", "grp"], value="similarity", window=window)
    finite = F.when(~F.isnan("similarity"), F.col("similarity"))
    return rolled.groupBy("pair", "grp").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(finite).alias("mean_similarity"),
        F.avg(F.when(finite.isNotNull(), (finite < 0).cast("double"))).alias("negative_share"),
        F.count("rolling").alias("n_rolling"),
        F.max_by("rolling", "idx").alias("last_rolling"))
