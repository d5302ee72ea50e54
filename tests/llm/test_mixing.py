from collections import Counter

import pytest

from taskweave.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare the excess by weight until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return target
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] = left * weight[s] / total
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
            full.add(s)
            left -= target[s]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 7, "d": 1, None: 3}, {"z": 10}, {None: 4, "": 9, "ü": 0, "é": 55, "A": 2},
                                   {str(i): (i * 37) % 101 for i in range(25)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want)
    assert {r.source: r.target for r in mixing.source_targets(df.repartition(4), few=False).collect()} == pytest.approx(want)


def test_many_sources_by_ranges(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(id % 11 + 1 as int)) text", "concat('s', id % 700) source")
    few = mixing.plan_mix(docs, keep=["doc_id"]).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = mixing.plan_mix(docs, keep=["doc_id"]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [tuple(map(pytest.approx, r)) for r in sorted(map(tuple, few))] == sorted(map(tuple, many))


def test_mix(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    words = lambda t: len((t or "").encode().split())
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    targets = brute_targets(sizes)
    planned = mixing.plan_mix(odd_docs, keep=["doc_id", "text", "source", "size"])
    names = planned.columns[4:]
    for r in planned.collect():
        size, total, target, rate, copies = (r[n] for n in names)
        assert (size, total) == (words(r.text), sizes[r.source]) and target == pytest.approx(targets[r.source])
        assert copies in (int(rate), int(rate) + 1) and copies <= 2 and rate == pytest.approx(target / total)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    times = Counter(str(r) for r in mixed.collect())
    again = Counter(str(r) for r in mixing.mix(odd_docs.repartition(5)).collect())
    assert times == again and max(times.values()) <= 2 * max(Counter(map(str, rows)).values())
    assert mixing.mix(no_docs).count() == 0 and mixing.plan_mix(no_docs).count() == 0


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('w ', cast(id % 7 + 1 as int)) text", "case when id % 3 = 0 then 'hot' else concat('s', id % 4) end source")
    planned = mixing.plan_mix(docs, keep=["source"])
    size, total, target, _, copies = planned.columns[1:]
    for r in planned.groupBy("source").agg({size: "sum"}).collect():
        assert r[1] > 0
    for r in planned.selectExpr("source", f"{size} * {copies} taken", f"{target} target").groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.1)
