"""Exact ranks without single-partition windows.

A window over a whole group (``row_number() over (partition by task ...)``) puts
every row of the group into one task; with one task holding a third of the data
that is the bottleneck.  ``bucketed_rank`` instead:

1. coarsens the ordering into an order-preserving ``bucket`` (hash prefix, time
   slice, count band ...),
2. counts rows per ``(group, bucket)`` -- a small table,
3. prefix-sums those counts per group (a window over the small table only),
4. ranks inside ``(group, bucket)`` and adds the prefix.

The join in (4) shuffles on ``(group, bucket)`` and the window reuses that
partitioning, so the plan has one exchange for the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir

DEFAULT_BUCKET_CHARS = 4  # 65,536 hash buckets per group
#: Thresholds of up to so many groups (some 100 bytes each) are broadcast; beyond, Spark joins them by sort and merge.
BROADCAST_GROUPS = 50_000


def draw_key(seed, salt, row_id) -> Column:
    """Seeded permutation key: ``md5('<seed>:<salt>:<id>')`` (lower-case hex)."""
    def lit_or_col(v):
        return v if isinstance(v, Column) else F.lit(str(v))
    return F.md5(F.concat(lit_or_col(seed), F.lit(":"), lit_or_col(salt), F.lit(":"),
                          (F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")))


def bucketed_rank(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column],
                  rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """1-based rank of each row within ``by`` ordered by ``order``.

    ``bucket`` must be monotone in ``order`` (rows of a lower bucket always sort
    first).  The result equals ``row_number() over (partition by by order by order)``.
    ``total_col`` also attaches the group size, taken from the small bucket-count
    table, so callers need no second aggregate over the data.
    """
    by = list(by)
    b = "__bucket"
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("__n").over(Window.partitionBy(*by)).alias(total_col)] if total_col else []
    offsets = counts.select(*by, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"), *extra)
    inner = Window.partitionBy(*by, b).orderBy(*order)
    return (df.join(offsets, [*by, b])
              .withColumn(rank_col, (F.row_number().over(inner) + F.col("__off")).cast("long"))
              .drop(b, "__off"))


def range_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """1-based global rank by ``order`` for orders without a natural bucket.

    Rows are dealt by range, sorted inside each partition and stored in the shared folder, which
    fixes their places; a rank is the place plus the rows of all earlier partitions.  The counts per
    partition that are summed up and broadcast are one row for each shuffle partition.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "ranked")
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .withColumn("__pid", F.spark_partition_id())
       .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
       .write.parquet(path))
    placed = spark.read.parquet(path)
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    return (placed.join(F.broadcast(before), "__pid")
            .withColumn(rank_col, (F.col("__at") + F.col("__before") + 1).cast("long")).drop("__pid", "__at", "__before"))


def hash_rank(df: DataFrame, by: Sequence[str], key: str, tiebreak: str,
              rank_col: str = "rank", bucket_chars: int = DEFAULT_BUCKET_CHARS,
              total_col: str | None = None) -> DataFrame:
    """Rank by a hex hash column ``key`` (ties broken by ``tiebreak``) within ``by``."""
    return bucketed_rank(df, by, F.substring(F.col(key), 1, bucket_chars),
                         [F.col(key), F.col(tiebreak)], rank_col, total_col)


def within_k_smallest(df: DataFrame, by: Sequence[str], key: str, tiebreak: str, k_fn, flag_col: str,
                      bucket_chars: int = DEFAULT_BUCKET_CHARS) -> DataFrame:
    """Flag rows among the ``k`` smallest ``(key, tiebreak)`` of their group, without ranking them all.

    ``k_fn`` receives the small per-bucket table (``*by, __b, __n, __off, __tot``) and returns it with a
    ``__k`` column, so ``k`` may depend on the group size or on other groups (e.g. the smallest group).
    From key columns only, the bucket that holds the k-th row of each group is found and ranked, which gives
    the exact k-th ``(key, tiebreak)``; the rows themselves are compared with it in one pass.  The thresholds
    are stored, one row for each group, and broadcast if there are at most ``BROADCAST_GROUPS`` of them.
    Equals ``row_number() over (partition by by order by key, tiebreak) <= k``.
    """
    by = list(by)
    keys = df.select(*by, F.col(key).alias("__key"), F.col(tiebreak).alias("__tie")) \
        .withColumn("__b", F.substring("__key", 1, bucket_chars))
    counts = keys.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__b", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                           F.sum("__n").over(Window.partitionBy(*by)).alias("__tot"))
    counts = k_fn(counts).withColumn("__k", F.least(F.col("__k"), F.col("__tot")))
    # one row for each group: the bucket with the k-th row
    cut = counts.where((F.col("__off") < F.col("__k")) & (F.col("__k") <= F.col("__off") + F.col("__n"))) \
        .select(*by, "__b", "__off", "__k")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__key", "__tie")) + F.col("__off")
    path = fresh_dir(df.sparkSession, "thresholds")
    (keys.join(cut, [*by, "__b"]).withColumn("__place", place).where(F.col("__place") == F.col("__k"))
         .select(*by, F.struct("__key", "__tie").alias("__last")).write.parquet(path))
    thresholds = df.sparkSession.read.parquet(path)
    if thresholds.count() <= BROADCAST_GROUPS:
        thresholds = F.broadcast(thresholds)
    inside = F.struct(F.col(key).alias("__key"), F.col(tiebreak).alias("__tie")) <= F.col("__last")
    return df.join(thresholds, by, "left").withColumn(flag_col, F.coalesce(inside, F.lit(False))).drop("__last")
