"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

``permute`` maps the row numbers 0..n-1 one to one onto themselves; shard and slot of a row follow from its
permuted number by arithmetic, so any row's place can be computed (and a place turned back into a row number by
``unpermute``) without a table.  Global row numbers come from one range shuffle of narrow rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_name, stored

ROUNDS = 6
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit hash of each element (multiply, xor and shift)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    x = np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
    out = []
    for i in range(ROUNDS):
        x = _mix(x, 0x51ED2701 + i)
        out.append(int(x[0]))
    return out


def _half_bits(n: int) -> int:
    """Half the width of the smallest even-width domain that holds 0..n-1; it is under four times as large."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & low)
    return (left << np.uint64(half)) | right


def _unfeistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in reversed(keys):
        left, right = right ^ (_mix(left, k) & low), left
    return (left << np.uint64(half)) | right


def _walk(step, rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    half, keys = _half_bits(n), _keys(seed)
    out = step(rows.astype(np.uint64), half, keys)
    outside = np.flatnonzero(out >= n)
    while outside.size:  # cycle walking: go on until the number is inside again
        out[outside] = step(out[outside], half, keys)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permuted number of each row number; a bijection on 0..n-1 for each seed."""
    return _walk(_feistel, rows, n, seed)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number that ``permute`` sends to each place."""
    return _walk(_unfeistel, places, n, seed)


def row_numbers(spark: SparkSession, df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with its global row number (0-based, in the order of the columns ``order``, nulls first).

    Rows are dealt by range on ``order`` and sorted inside each partition; the sorted rows are stored, so their
    partition and place are fixed, and a row's number is its place plus the rows of all earlier partitions.  Only the
    counts per partition (one row each) are summed up and broadcast.  ``df`` should be narrow.
    """
    pid, at, before = (new_name(df, x) for x in ("__pid", "__at", "__before"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(spark, ranged.withColumn(pid, F.spark_partition_id())
                    .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "row-numbers")
    counts = placed.groupBy(pid).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(pid, (F.sum("n").over(Window.orderBy(pid)) - F.col("n")).alias(before))
    # one row for each partition of the range shuffle: bounded by the number of shuffle partitions
    return (placed.join(F.broadcast(starts), pid)
            .withColumn(name, (F.col(at) + F.col(before)).cast("long")).drop(pid, at, before))


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Deal all documents into ``n_shards`` shards in a reproducible random order.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each input row.  ``size`` is the
    text's UTF-8 bytes plus 16, ``text_crc32`` its unsigned CRC-32.  Row numbers follow ``(doc_id, crc32, size, 64-bit
    hash)``; the row with permuted number p is in shard ``p mod n_shards`` at slot ``p div n_shards``.  So the law is
    ``rows``: shard sizes differ by one row at most and slots have no gap.  ``grown_shard`` is null under this law.

    Nulls: a null text counts no bytes (size 16, CRC 0); a null doc_id sorts first.  Repeated rows each get a place of
    their own; equal ones are interchangeable.  An empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = stored(spark, docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("at")), "shard-rows")
    n = narrow.count()
    numbered = row_numbers(spark, narrow, ["doc_id", "text_crc32", "size", "hash", "at"])  # the last one splits equal rows

    @F.pandas_udf(T.LongType())
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    p = numbered.withColumn("place", place("row_number"))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("place") % n_shards).cast("int").alias("shard"),
                    F.floor(F.col("place") / F.lit(n_shards)).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"))
