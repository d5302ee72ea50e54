"""Registered queries: gradient interference (2.D J4, 2.G A10, 2.H V5-V9, 2.E F3-F4),
series windows (2.I) and the interference report (C6)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from .catalog import query
from .operators import interference as I
from .operators import metrics as M
from .operators import windows as W
from .operators.ranking import bucketed_rank
from .plans import fixtures as X
from .plans.interference_report import interference_report


#: Steps that are numbered together.
SLICE = 4096


def _r(c, n=6):
    return F.round(c, n)


def _pairs(spark, sf):
    return I.task_pairs(I.task_order(X.fg(spark, sf)))


@query("join_task_pairs")
def q_join_task_pairs(spark, sf):
    return _pairs(spark, sf).select(F.col("ord_1").cast("int"), "task_1", F.col("ord_2").cast("int"), "task_2", "pair")


@query("grad_concat_groups")
def q_grad_concat_groups(spark, sf):
    return I.concat_layout(X.fg(spark, sf)).withColumn("sq_norm", _r(F.col("sq_norm")))


def _group_sims(spark, sf):
    g = X.fg(spark, sf)
    return I.group_cosines(g, I.task_pairs(I.task_order(g)))


@query("grad_cosine_groups")
def q_grad_cosine_groups(spark, sf):
    return _group_sims(spark, sf).withColumn("similarity", _r(F.col("similarity")))


@query("filter_pair_prefix")
def q_filter_pair_prefix(spark, sf):
    return I.filter_pair_prefix(_group_sims(spark, sf), "t0").select(
        "step", "pair", "grp", _r(F.col("similarity")).alias("similarity"))


@query("grad_cosine_per_param")
def q_grad_cosine_per_param(spark, sf):
    return I.per_param_cosines(X.fg_phased(spark, sf), "t0", "t1").withColumn("similarity", _r(F.col("similarity")))


@query("agg_grad_accumulate")
def q_agg_grad_accumulate(spark, sf):
    g = X.fg(spark, sf)
    parts = [I.accumulate(g, m).withColumn("mode", F.lit(m)) for m in I.ACCUMULATE_MODES]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select("mode", "step", "owner", "param", F.posexplode("g").alias("i", "g")).withColumn("g", _r(F.col("g")))


@query("grad_param_update")
def q_grad_param_update(spark, sf):
    g = X.fg(spark, sf)
    theta0 = g.groupBy("param", "chunk").agg(vector_to_array(Summarizer.mean(array_to_vector("g"))).alias("g"))
    traj = I.parameter_trajectory(theta0, I.accumulate(g, "sum"), lr=1e-3)
    return traj.select("step", "param", F.posexplode("g").alias("i", "value")).withColumn("value", _r(F.col("value")))


@query("grad_clip_global_norm")
def q_grad_clip_global_norm(spark, sf):
    c = I.clip_global_norm(X.fg(spark, sf), max_norm=1.0)
    return c.select("step", "task", "param", _r(F.col("total_norm")).alias("total_norm"), _r(F.col("coef")).alias("coef"),
                    F.posexplode("g").alias("i", "g")).withColumn("g", _r(F.col("g")))


@query("filter_every_nth")
def q_filter_every_nth(spark, sf):
    return I.filter_every_nth(X.fs(spark, sf), 10, step="idx").select("series", "idx", "value")


@query("win_rolling_mean")
def q_win_rolling_mean(spark, sf):
    r = W.rolling_mean(X.fs(spark, sf), ["series"], window=20)
    return r.select("series", "idx", "value", _r(F.col("rolling")).alias("rolling"))


@query("win_step_axis")
def q_win_step_axis(spark, sf):
    s = I.filter_every_nth(X.fs(spark, sf), 10, step="idx").withColumn("idx", (F.col("idx") / 10).cast("long"))
    return W.step_axis(s, every=10).select("series", "idx", "x", "value")


def _acc_series(spark, sf):
    """Values in [0, 1), every seventh of them NaN (the best of a series among them)."""
    share = F.col("value") % 1
    return X.fs(spark, sf).withColumn("value", F.when((F.col("idx") % 7 == 3) | (share > 0.98), F.lit(float("nan"))).otherwise(share))


@query("win_running_best")
def q_win_running_best(spark, sf):
    r = M.running_best(_acc_series(spark, sf), ["series"])
    return r.select("series", "idx", _r(F.col("value")).alias("value"), _r(F.col("prev_best")).alias("prev_best"))


@query("topk_best_epoch")
def q_topk_best_epoch(spark, sf):
    b = M.best_epoch(_acc_series(spark, sf), ["series"])
    return b.select("series", "best_epoch", _r(F.col("best_value")).alias("best_value"))


@query("win_epoch_history")
def q_win_epoch_history(spark, sf):
    h = M.epoch_history(X.fm(spark, sf))
    cols = ["train_accuracy", "train_loss", "val_accuracy", "val_loss"]
    return h.select("run", "task", "epoch", *[_r(F.col(c)).alias(c) for c in cols])


@query("job_interference_report")
def q_job_interference_report(spark, sf):
    g = X.fg(spark, sf)
    r = interference_report(g, I.task_order(g), every_nth=1, window=20)
    return r.select("pair", "grp", "n_points", _r(F.col("mean_similarity")).alias("mean_similarity"),
                    _r(F.col("negative_share")).alias("negative_share"), "n_rolling",
                    _r(F.col("last_rolling")).alias("last_rolling"))


@query("win_epoch_history_long")
def q_win_epoch_history_long(spark, sf):
    cols = ["train_accuracy", "train_loss", "val_accuracy", "val_loss"]
    wide = M.epoch_history(X.fm(spark, sf))
    back = M.history_to_long(wide, ["run", "task", "epoch"], cols)
    return back.select("run", "task", "epoch", "split", "name", _r(F.col("value")).alias("value"))


@query("best_macro_epoch")
def q_best_macro_epoch(spark, sf):
    """A8 -> W3 -> W4: best epoch of a run by the mean validation accuracy over its tasks."""
    val = X.fm(spark, sf).where((F.col("split") == "val") & (F.col("name") == "accuracy"))
    macro = M.macro_task_mean(val.withColumnRenamed("value", "accuracy"), cols=("accuracy",), keys=("run", "epoch"))
    series = macro.select("run", "epoch", F.col("macro_accuracy").alias("value"))
    better = M.running_best(series, ["run"], idx="epoch").groupBy("run").agg(F.count(F.lit(1)).alias("n_improvements"))
    best = M.best_epoch(series, ["run"], idx="epoch")
    return best.join(better, "run", "left").select("run", "best_epoch", _r(F.col("best_value")).alias("best_value"),
                                                   F.coalesce("n_improvements", F.lit(0)).alias("n_improvements"))


@query("best_task_epoch")
def q_best_task_epoch(spark, sf):
    """W4 for each task: the epoch with its best validation accuracy, and how often it improved."""
    val = X.fm(spark, sf).where((F.col("split") == "val") & (F.col("name") == "accuracy")).select("run", "task", "epoch", "value")
    better = M.running_best(val, ["run", "task"], idx="epoch").groupBy("run", "task").agg(F.count(F.lit(1)).alias("n_improvements"))
    best = M.best_epoch(val, ["run", "task"], idx="epoch")
    return best.join(better, ["run", "task"], "left").select("run", "task", "best_epoch", _r(F.col("best_value")).alias("best_value"),
                                                             F.coalesce("n_improvements", F.lit(0)).alias("n_improvements"))


@query("similarity_series")
def q_similarity_series(spark, sf):
    """V6 -> F3 -> W1 -> W2: the smoothed similarity series of one anchor task, with its step axis."""
    sims = I.filter_pair_prefix(_group_sims(spark, sf), "t0")
    # one row for each sampled step; steps are numbered in slices, so no task sorts a whole series
    series = bucketed_rank(sims, ["pair", "grp"], F.floor(F.col("step") / SLICE), [F.col("step")], "rk").withColumn("idx", F.col("rk") - 1)
    smooth = W.rolling_mean(series, ["pair", "grp"], value="similarity", window=5, block=4096)
    return W.step_axis(smooth, every=10).select("pair", "grp", "idx", "x", _r(F.col("similarity")).alias("similarity"),
                                                _r(F.col("rolling")).alias("rolling"))
