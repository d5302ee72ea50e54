"""Properties of the sampling, ranking and window operators on the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from table_paths import SF_MID, SF_SMALL
from taskweave.operators import metrics as M
from taskweave.operators import ranking as R
from taskweave.operators import sampling as P
from taskweave.operators import windows as W
from taskweave.plans import fixtures as X


def test_bucketed_rank_equals_plain_window(spark):
    v = X.fv(spark, SF_MID).withColumn("k", R.draw_key(3, "x", "row_id"))
    for chars in (1, 2, 4):
        got = R.hash_rank(v, ["task"], "k", "row_id", "rk", bucket_chars=chars)
        ref = v.withColumn("rk2", F.row_number().over(Window.partitionBy("task").orderBy("k", "row_id")))
        bad = got.join(ref, "row_id").where(F.col("rk") != F.col("rk2")).count()
        assert bad == 0


def test_split_disjoint_and_sized(spark):
    s = P.split_holdout(X.fd_raw(spark, SF_MID))
    assert s.count() == s.select("row_id").distinct().count()
    for r in s.groupBy("task").agg(F.count("*").alias("n"), F.sum((F.col("split") == "val").cast("int")).alias("v")).collect():
        import math
        assert r.v == math.ceil(r.n * 0.3)


def test_balance_equal_counts(spark):
    s = P.balance_min_downsample(P.split_holdout(X.fv(spark, SF_MID)))
    counts = s.groupBy("split", "task").count().collect()
    for split in ("train", "val"):
        assert len({r["count"] for r in counts if r.split == split}) == 1


def test_every_pass_is_a_permutation(spark):
    v = X.fv(spark, SF_SMALL).select("row_id", "task", "emotion_ind")
    ep = P.episode_sampler(v, k=10, epochs=3)
    sizes = {(r.task, r.emotion_ind): r["count"] for r in v.groupBy("task", "emotion_ind").count().collect()}
    # consecutive draws of one class never repeat a row within a pass
    w = Window.partitionBy("task", "emotion_ind").orderBy("epoch", "episode", "pos")
    seq = ep.withColumn("n", F.row_number().over(w) - 1).collect()
    by = {}
    for r in seq:
        by.setdefault((r.task, r.emotion_ind), []).append((r.n, r.row_id))
    for key, items in by.items():
        n = sizes[key]
        ids = [rid for _, rid in sorted(items)]
        for start in range(0, len(ids) - n + 1, n):
            assert len(set(ids[start:start + n])) == n


def test_support_and_query_cover_draw(spark):
    v = X.fv(spark, SF_SMALL).select("row_id", "task", "emotion_ind")
    ep = P.episode_support_query(P.episode_sampler(v, k=10, epochs=1))
    assert ep.count() == ep.where(F.col("role").isin("support", "query")).count()


def test_rolling_blocks_match_unblocked(spark):
    s = X.fs(spark, SF_SMALL)
    a = W.rolling_mean(s, ["series"], block=20)
    b = W.rolling_mean(s, ["series"], block=1 << 30)
    diff = a.alias("a").join(b.alias("b"), ["series", "idx"]).where(
        ~F.col("a.rolling").eqNullSafe(F.col("b.rolling")) &
        ~(F.abs(F.col("a.rolling") - F.col("b.rolling")) < 1e-12)).count()
    assert diff == 0


def test_running_best_blocks_match(spark):
    s = X.fs(spark, SF_SMALL).withColumn("value", F.col("value") % 1)
    a = {(r.series, r.idx) for r in M.running_best(s, ["series"], block=7).collect()}
    b = {(r.series, r.idx) for r in M.running_best(s, ["series"], block=1 << 30).collect()}
    assert a == b and a


def test_series_index_contiguous(spark):
    s = X.fs(spark, SF_SMALL)
    for r in s.groupBy("series").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n")).collect():
        assert r.lo == 0 and r.hi == r.n - 1


def test_range_rank_equals_plain_window(spark):
    v = X.fv(spark, SF_MID).withColumn("k", F.substring(R.draw_key(3, "x", "row_id"), 1, 1))    # many ties
    got = R.range_rank(v, [F.col("k").desc(), F.col("row_id")], "rk")
    ref = v.withColumn("rk2", F.row_number().over(Window.orderBy(F.col("k").desc(), "row_id")))
    assert got.join(ref, "row_id").where(F.col("rk") != F.col("rk2")).count() == 0 and got.count() == v.count()


def test_vocabulary_with_a_hot_token_and_many_single_ones(spark):
    from taskweave.operators import tokenize as TK
    rows = spark.range(4000).selectExpr("cast(id as string) row_id", "concat(if(id % 2 = 0, 'the ', ''), 'aa', id, ' aa', id + 100000, if(id % 2 = 0, ' the', '')) tweet")
    tok = TK.tokenize_text(rows)
    vocab = {r.token: r.id for r in TK.build_vocab(tok).collect()}
    assert vocab["the"] == 4 and sorted(vocab.values()) == list(range(4, 4 + len(vocab)))
    singles = sorted(t for t in vocab if t != "the")
    assert [vocab[t] for t in singles] == list(range(5, 5 + len(singles)))
    for head in (1, 3, 20_000):
        old, TK.HEAD_TOKENS = TK.HEAD_TOKENS, head
        got = {r.row_id: r.input_ids for r in TK.encode_fixed(tok, TK.build_vocab(tok), max_len=6).collect()}
        TK.HEAD_TOKENS = old
        for r in rows.collect():
            ids = [vocab[t] for t in r.tweet.split()][:4]
            assert got[r.row_id] == [1, *ids, 2] + [0] * (4 - len(ids))


def test_value_counts_rank_descending(spark):
    from taskweave.operators import corpus as C
    from taskweave.plans.corpus_build import corpus_from_tables
    vc = C.value_counts(corpus_from_tables(spark, SF_SMALL)).collect()
    by = {}
    for r in vc:
        by.setdefault((r.split, r.level), []).append((r["rank"], r.n))
    for items in by.values():
        ns = [n for _, n in sorted(items)]
        assert ns == sorted(ns, reverse=True) and sorted(k for k, _ in items) == list(range(1, len(items) + 1))


def test_within_k_smallest_equals_rank_cut(spark):
    v = X.fv(spark, SF_MID).withColumn("key", R.draw_key(3, "x", "row_id"))
    ref = v.withColumn("rk", F.row_number().over(Window.partitionBy("task").orderBy("key", "row_id"))) \
        .withColumn("tot", F.count("*").over(Window.partitionBy("task")))
    for chars in (1, 2, 4):
        for name, kf, kref in (("third", lambda c: c.withColumn("__k", F.ceil(F.col("__tot") / 3)), F.ceil(F.col("tot") / 3)),
                               ("zero", lambda c: c.withColumn("__k", F.lit(0)), F.lit(0)),
                               ("all", lambda c: c.withColumn("__k", F.col("__tot")), F.col("tot")),
                               ("more", lambda c: c.withColumn("__k", F.col("__tot") + 5), F.col("tot") + 5)):
            got = R.within_k_smallest(v, ["task"], "key", "row_id", kf, "inside", bucket_chars=chars)
            j = got.select("row_id", "inside").join(ref.select("row_id", (F.col("rk") <= kref).alias("want")), "row_id")
            assert j.count() == v.count()
            assert j.where(F.col("inside") != F.col("want")).count() == 0, (chars, name)


def _plain_streams(rows, by, k, n_draws, salt, seed=3):
    """Draw g of each stream: batch g mod nb of the pass g div nb, each pass a permutation by md5 (plain Python)."""
    import hashlib
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in by), []).append(r["row_id"])
    for key, ids in groups.items():
        nb = -(-len(ids) // k)
        for g in range(n_draws):
            order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{salt}{g // nb}:{i}".encode()).hexdigest(), i))
            out[key, g] = order[g % nb * k:(g % nb + 1) * k]
    return out


def test_samplers_equal_plain_streams(spark):
    v = X.fv(spark, SF_SMALL).select("row_id", "task", "emotion_ind")
    rows = v.collect()
    sizes = {}
    for r in rows:
        sizes[r.task, r.emotion_ind] = sizes.get((r.task, r.emotion_ind), 0) + 1
    least = min(-(-n // 7) for n in sizes.values())
    got = {}
    for r in P.episode_sampler(v, k=7, epochs=3).collect():
        got.setdefault(((r.task, r.emotion_ind), r.epoch * least + r.episode), {})[r.pos] = r.row_id
    want = _plain_streams(rows, ["task", "emotion_ind"], 7, 3 * least, "")
    assert {k: [x for _, x in sorted(d.items())] for k, d in got.items()} == want
    for mode in ("min", "mean_max_min"):
        tasks = {}
        for r in rows:
            tasks[r.task] = tasks.get(r.task, 0) + 1
        nb = [-(-n // 8) for n in tasks.values()]
        steps = min(nb) if mode == "min" else int((max(nb) + min(nb)) / 2)
        for epoch in range(2):
            got = {}
            for r in P.multitask_step_schedule(v.select("row_id", "task"), 8, epochs=2, mode=mode).where(F.col("epoch") == epoch).collect():
                got.setdefault(((r.task,), r.step), {})[r.pos] = r.row_id
            want = _plain_streams(rows, ["task"], 8, steps, f"{epoch}:")
            assert {k: [x for _, x in sorted(d.items())] for k, d in got.items()} == want
