import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from taskweave.llm import shuffle
from taskweave.llm.common import bounded_sample


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    places = shuffle.permute(rows, n, 7)
    assert sorted(places.tolist()) == list(range(n))
    assert (shuffle.unpermute(places, n, 7) == rows).all()
    if n > 60:
        assert (places != shuffle.permute(rows, n, 8)).any()
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.35


def test_shards(spark, odd_docs):
    first = shuffle.shard_documents(spark, odd_docs, 5).collect()
    again = shuffle.shard_documents(spark, odd_docs.repartition(7), 5).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    want = sorted(str((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))) for r in odd_docs.collect())
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in first) == want
    by_shard: dict = {}
    for r in first:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by_shard) == set(range(5)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def plain_places(n, seed):
    """Feistel rounds and cycle walking on Python integers."""
    whole = (1 << 64) - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & whole
        x ^= x >> 31
        x = x * 0xD6E8FEB86659FD93 & whole
        return x ^ x >> 32

    keys, x = [], seed
    for i in range(6):
        x = mix(x, 0x51ED2701 + i)
        keys.append(x)
    half = next(h for h in range(1, 33) if 1 << 2 * h >= max(n, 2))
    low = (1 << half) - 1

    def step(x):
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ mix(right, k) & low
        return left << half | right

    out = []
    for row in range(n):
        x = step(row)
        while x >= n:
            x = step(x)
        out.append(x)
    return out


def test_every_row_is_where_the_plain_permutation_puts_it(spark, odd_docs):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = []
    for r in odd_docs.collect():
        b = (r.text or "").encode()
        rows.append(((r.doc_id is not None, r.doc_id or 0), zlib.crc32(b), len(b) + 16, signed(xxhash.xxh64_intdigest(b, 42)), r.doc_id))
    rows.sort()
    want = [(i, size, crc, p % 7, p // 7) for (_, crc, size, _, i), p in zip(rows, plain_places(len(rows), 7))]
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shuffle.shard_documents(spark, odd_docs, 7).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_equal_rows_are_dealt_over_tasks(spark):
    docs = spark.range(5000).selectExpr("3L AS doc_id", "'same' AS text").repartition(4)
    out = shuffle.shard_documents(spark, docs, 11).collect()
    assert sorted((r.slot, r.shard) for r in out) == sorted((p // 11, p % 11) for p in range(5000))


def test_row_numbers_follow_the_order(spark):
    df = spark.range(500).selectExpr("cast((id * 7919) % 500 as long) as x", "id as __pid", "id as n")
    got = {r.x: r.row_number for r in shuffle.row_numbers(spark, df, ["x"]).collect()}
    assert got == {x: x for x in range(500)}


def test_fewer_rows_than_shards_and_none(spark, odd_docs, no_docs):
    few = shuffle.shard_documents(spark, odd_docs.limit(3), 40).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}
    assert shuffle.shard_documents(spark, no_docs, 40).count() == 0


def test_bounded_sample(spark):
    df = spark.range(5000)
    got = [r.id for r in bounded_sample(df, 5000, 100, "id").collect()]
    assert len(got) == 100 and got == [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert bounded_sample(df.limit(7), 7, 100, "id").count() == 7
