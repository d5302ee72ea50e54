"""Series windows (W1, W2) that stay parallel on long series.

A series window ``partitionBy(series).orderBy(idx)`` sorts a whole series in
one task.  ``rolling_mean`` cuts each series into blocks of ``block`` positions
and copies the last ``window-1`` positions of every block into the next one
(a halo), so every block computes its windows independently and exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(series: DataFrame, keys: Sequence[str], idx: str = "idx", value: str = "value",
                 window: int = 20, block: int = 4096, out: str = "rolling") -> DataFrame:
    """Trailing mean over ``window`` positions ``[idx-window+1, idx]``.

    NULL unless all ``window`` positions exist and are numbers (NaN counts as
    missing), like ``rolling(window).mean()``.
    """
    if block < window:
        raise ValueError("block must be at least the window length")
    keys = list(keys)
    base = series.withColumn("__blk", F.floor(F.col(idx) / block)).withColumn("__halo", F.lit(False))
    halo = (base.where(F.col(idx) % block >= block - (window - 1))
            .withColumn("__blk", F.col("__blk") + 1).withColumn("__halo", F.lit(True)))
    both = base.unionByName(halo)
    v = F.when(F.isnan(F.col(value)), F.lit(None)).otherwise(F.col(value))
    w = Window.partitionBy(*keys, "__blk").orderBy(F.col(idx)).rangeBetween(-(window - 1), 0)
    both = both.withColumn("__v", v)
    res = both.withColumn(out, F.when(F.count("__v").over(w) == window, F.avg("__v").over(w)))
    return res.where(~F.col("__halo")).drop("__blk", "__halo", "__v")


def step_axis(series: DataFrame, idx: str = "idx", every: int = 10, out: str = "x") -> DataFrame:
    """Training-step coordinate of a sampled series point: ``x = idx * every``."""
    return series.withColumn(out, (F.col(idx) * every).cast("long"))
