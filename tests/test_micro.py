"""Golden micro-cases for every quirk the reference's behaviour depends on."""

import math

from pyspark.sql import functions as F

from taskweave.functions import labels as L
from taskweave.functions import text as T
from taskweave.operators import interference as I
from taskweave.operators import metrics as M
from taskweave.operators import sampling as P
from taskweave.operators import windows as W
from taskweave.plans import fixtures as X


def one(spark, col_expr, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_expr).collect()]


def test_binary_label_string_and_numeric(spark):
    got = one(spark, L.binary_label("v"), ["NOT", "not_sarcastic", "OFF", "0", "non_sarcastic", None])
    assert got == [0, 0, 1, 1, 1, 1]
    assert one(spark, L.binary_label("v", numeric=True), [0, 1, 3, None], "v int") == [0, 1, 1, 1]


def test_class_name_null_is_negative(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "i int")
    assert [r[0] for r in df.select(L.class_name("i", "hate")).collect()] == ["hate", "non_hate", "non_hate"]


def test_intensity_class(spark):
    got = one(spark, L.intensity_class("v"), ["0: no joy", "3: sadness and joy", "10: joy", "2: calm", None])
    assert got == ["non_joy", "sadness", "non_joy", None, None]


def test_intensity_split_shapes(spark):
    p = L.intensity_parts("v")
    df = spark.createDataFrame([("2: a",), ("2: a: b",), (": fear",)], "v string")
    rows = df.select(p["emotion_ind"], p["emo_desc"], p["n_parts"]).collect()
    assert [tuple(r) for r in rows] == [(2, " a", 2), (2, " a", 3), (None, " fear", 2)]


def test_mention(spark):
    assert one(spark, T.strip_mention("v"), ["a@b.com", "@jo_é² hi"]) == ["a.com", " hi"]


def test_tco_as_written_needs_missing_colon(spark):
    assert one(spark, T.strip_tco("v"), ["http://t.co/x", "http//t.co/x y"]) == ["http://t.co/x", " y"]


def test_rt_inside_words_and_case(spark):
    assert one(spark, T.strip_rt("v"), ["ART x", "rt x", "RT x", "RT x"]) == ["Ax", "rt x", "x", "x"]
    assert one(spark, T.strip_rt("v", T.INTENDED), ["ART x", "RT x"]) == ["ART x", "x"]


def test_url_needs_capital_s(spark):
    assert one(spark, T.strip_url("v"), ["https://Sab", "https://example.org"]) == ["ab", "https://example.org"]


def test_emoticon_noop_as_written(spark):
    assert one(spark, T.strip_emoticon("v"), [":-) hi"]) == [":-) hi"]
    assert one(spark, T.strip_emoticon("v", T.INTENDED), [":-) hi"]) == [" hi"]


def test_emoji_sequences(spark):
    src = "\U0001F44D\U0001F3FD ok \U0001F468‍\U0001F469‍\U0001F467 ❤️ 1️⃣ \U0001F1EB\U0001F1F7 # * 5"
    assert one(spark, T.strip_emoji("v"), [src]) == [" ok     # * 5"]


def test_sanitize_chain(spark):
    s = "RT @usr_1 ART hello #tag https://Sabc http//t.co/zz :-) \U0001F600"
    # RT+space cut at the start and inside "ART"; only "https://S" of the URL is cut
    assert one(spark, T.sanitize("v"), [s]) == ["Ahello tag abc  :-) "]


def test_split_sizes_follow_float_ceil(spark):
    for n, val in ((10, 3), (11, 4), (100, 30), (7, 3)):
        df = spark.createDataFrame([(str(i), "t") for i in range(n)], "row_id string, task string")
        got = {r["split"]: r["count"] for r in P.split_holdout(df).groupBy("split").count().collect()}
        assert got == {"val": val, "train": n - val}


def test_support_query_halves(spark):
    rows = [(0, 0, "t", 0, p) for p in range(5)] + [(0, 0, "t", 1, 0)]
    df = spark.createDataFrame(rows, "epoch int, episode int, task string, emotion_ind int, pos int")
    got = P.episode_support_query(df).groupBy("emotion_ind", "role").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, "support"): 2, (0, "query"): 3, (1, "query"): 1}


def test_schedule_modes_and_cycling(spark):
    rows = [(f"a{i}", "a") for i in range(3)] + [(f"b{i}", "b") for i in range(8)]
    df = spark.createDataFrame(rows, "row_id string, task string")
    steps = lambda m: P.multitask_step_schedule(df, 1, mode=m).select("step").distinct().count()
    assert steps("min") == 3 and steps("zip_shortest") == 3 and steps("mean_max_min") == 5
    a = P.multitask_step_schedule(df, 1, mode="mean_max_min").where("task = 'a'").orderBy("step").collect()
    first, second = [r.row_id for r in a[:3]], [r.row_id for r in a[3:]]
    assert sorted(first) == ["a0", "a1", "a2"] and len(second) == 2 and len(set(second)) == 2


def test_rolling_mean_window_rules(spark):
    vals = [float(i) for i in range(30)]
    vals[25] = float("nan")
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "series string, idx long, value double")
    r = {x.idx: x.rolling for x in W.rolling_mean(df, ["series"], block=24).collect()}
    assert all(r[i] is None for i in range(19))
    assert r[19] == sum(range(20)) / 20
    assert all(r[i] is None for i in range(25, 30))
    assert r[24] == sum(range(5, 25)) / 20


def test_running_best_starts_at_zero(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.0, 0.5, 0.5, 0.7])],
                               "series string, idx long, value double")
    assert [r.idx for r in M.running_best(df, ["series"]).orderBy("idx").collect()] == [1, 3]
    b = M.best_epoch(df, ["series"]).first()
    assert (b.best_epoch, b.best_value) == (3, 0.7)
    z = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 0.0)], "series string, idx long, value double")
    zb = M.best_epoch(z, ["series"]).first()
    assert (zb.best_epoch, zb.best_value) == (0, 0.0)


def test_cosine_zero_and_identical(spark):
    rows = [(0, "a", "enc", 0, 0, [1.0, 2.0]), (0, "b", "enc", 0, 0, [1.0, 2.0]), (0, "c", "enc", 0, 0, [0.0, 0.0])]
    g = spark.createDataFrame(rows, "step int, task string, param string, param_ord int, chunk int, g array<double>")
    sims = I.group_cosines(g, I.task_pairs(I.task_order(["a", "b", "c"], spark)))
    got = {(r.pair, r.grp): r.similarity for r in sims.collect()}
    assert abs(got[("a-b", "encoder")] - 1.0) < 1e-12
    assert math.isnan(got[("a-c", "encoder")]) and math.isnan(got[("b-c", "all_model")])
    assert set(p for p, _ in got) == {"a-b", "a-c", "b-c"}


def test_task_pairs_in_list_order(spark):
    pairs = I.task_pairs(I.task_order(["x", "a", "m"], spark)).orderBy("ord_1", "ord_2").collect()
    assert [p.pair for p in pairs] == ["x-a", "x-m", "a-m"]


def test_clip_global_norm(spark):
    g = spark.createDataFrame([(0, "a", "p", [3.0, 4.0])], "step int, task string, param string, g array<double>")
    r = I.clip_global_norm(g, 1.0).first()
    assert abs(r.total_norm - 5.0) < 1e-12 and abs(r.g[0] - 3.0 / (5.0 + 1e-6)) < 1e-12


def test_vocabulary_cleans_each_text_once(spark):
    from taskweave.operators import tokenize as TK
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cleaned(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["b a b", "", None, "  ", "a c", "b"])], "row_id string, tweet string")
    tok = TK.tokenize_text(rows.select("row_id", cleaned("tweet").alias("tweet")), materialize=False)
    assert [tuple(r) for r in TK.build_vocab(tok).orderBy("id").collect()] == [("b", 3, 4), ("a", 2, 5), ("c", 1, 6)]
    assert seen.value == 6


def test_texts_without_a_keycap_mark_are_not_searched_for_keycaps(spark):
    # both ways give what the whole pattern gives, keycaps that close up where an emoji stood included
    texts = [*X.EMOJI_CASES, "1\u20e3 2", "1\U0001F600\u20e3", "#\u2122\ufe0f\u20e3 a", "\u20e3", "\u2764\ufe0f\u200d\U0001F525x", "é1#*中\u2713\u3030", "", None]
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace("v", T.EMOJI, ""), T.EMOJI, ""), T.EMOJI, "")
    assert one(spark, F.regexp_replace(T.strip_emoji("v"), "[#@]", ""), texts) == one(spark, F.regexp_replace(F.regexp_replace("v", T.EMOJI, ""), "[#@]", ""), texts)
    assert one(spark, T.sanitize("v"), texts) == one(spark, F.regexp_replace(whole, "#", ""), texts)
    # the pattern for texts without the mark holds no keycap alternative
    assert "20E3" not in T.EMOJI_NO_KEYCAP


def test_records_of_files_are_read_once_whatever_follows(spark, tmp_path):
    from taskweave.sources import records
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2,z\n')
    found = records.read_records(spark, str(tmp_path / "a.csv"))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.record for r in found.where("NOT leads").collect()) == ['1,"x\ny"', "2,z"]
