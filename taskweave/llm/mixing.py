"""Mixing sources to target weights by repetition and hash-seeded Bernoulli copies (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, new_name, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Up to so many sources (some 100 bytes each) are summed up in one task and their targets broadcast; beyond, their sums are
#: taken by ranges and the targets join by sort and merge.
BROADCAST_SOURCES = 50_000


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` over all rows that come before in ``order``: rows are dealt by range and summed up
    inside their range, and the ranges' totals (a row for each shuffle partition) are summed up before them."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    placed = stored(spark, ranged, "mix-ranges")
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    local = placed.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return local.join(offsets, "__range").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def _in_one_task(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, few: bool = True) -> DataFrame:
    """``source, source_size`` -> the same with ``target`` (one row for each source).

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all sizes by weight; a target
    stops at ``most`` times its source's size and what is above goes to the others by weight, until none is above.
    That fixed point is the water level L with ``target = least(L * weight, most * size)``: sources fill up in the
    order of ``most * size / weight``, so L follows from running sums in that order.  With ``share > most`` all
    sources end full.  Sources of size 0 have target 0.  The running sums of ``few`` sources are one task's, else they are
    taken by ranges.
    """
    running = _in_one_task if few else _running
    unnamed = F.col("source").isNull()
    s = running(sizes, [unnamed, F.col("source")], {"turn": F.lit(1)})
    s = s.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights)).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = running(s.drop("turn"), [F.col("full_at"), unnamed, F.col("source")], {"full_caps": F.col("cap"), "full_weight": F.col("weight")})
    total, weight = s.agg((F.sum("source_size") * F.lit(float(share))), F.sum("weight")).first()
    s = s.withColumn("level", (F.lit(total).cast("double") - F.col("full_caps")) / (F.lit(weight).cast("double") - F.col("full_weight")))
    # the level is the first one that does not fill its own source
    (first,) = s.agg(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", unnamed.alias("unnamed"), "source", "level")))).first()
    level = F.lit(first["level"] if first else None).cast("double")
    return s.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 12 hex digits of md5('seed:doc_id'); a null id counts as the word null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def plan_mix(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: list[str] | None = None) -> DataFrame:
    """How often each document is taken: ``keep`` columns, then size, source size, target, rate and copies.

    Words are counted over whole texts, summed by source (pre-aggregated before the shuffle, so a source with a third
    of all rows is no hot key), turned into targets, and each document is taken ``floor(rate)`` times plus once more
    if its hash-seeded number is below the rate's fraction (rate = target / source size).  So no document is taken
    more than ``ceil(most)`` times.  The targets (one row for each source) are stored and counted: they join back by
    broadcast up to ``BROADCAST_SOURCES`` rows, else by sort and merge, where Spark splits a hot source.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id draws as the word null.
    Rows that repeat a doc_id draw alike.  Sources of size 0 have rate 0.  An empty table gives an empty result.
    """
    keep = keep or []
    size, source, total, target, rate, copies = (new_name(docs, f"__{c}") for c in ("size", "source", "total", "target", "rate", "copies"))
    sized = docs.select(*keep, n_words(F.col(text_col).cast("string")).alias(size),
                        F.col(source_col).cast("string").alias(source), chance(F.col(id_col), seed).alias(rate))
    if text_col not in keep:
        sized = stored(docs.sparkSession, sized, "mix-sizes")  # narrow: words are counted once
    sizes = sized.select(F.col(source).alias("source"), F.col(size).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    by = new_name(docs, "__source_key")
    sizes = stored(docs.sparkSession, sizes, "mix-sources")
    few = sizes.count() <= BROADCAST_SOURCES
    targets = stored(docs.sparkSession, source_targets(sizes, weights, share, most, few), "mix-targets").select(
        F.col("source").alias(by), F.col("source_size").alias(total), F.col("target").alias(target))
    if few:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col(by)))
    wanted = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    taken = (F.floor(wanted) + (F.col(rate) < wanted - F.floor(wanted)).cast("long")).cast("long")
    return joined.select(*keep, size, total, target, wanted.alias(rate), taken.alias(copies))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as ``plan_mix`` takes it, with the input's columns."""
    planned = plan_mix(docs, keep=docs.columns, **options)
    copies = planned.columns[-1]
    times = new_name(planned, "__time")
    return (planned.where(F.col(copies) > 0)
            .withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns))
