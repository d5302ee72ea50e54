"""Registered gradient and adaptation jobs: C1-C4 at formula parameters as single plans, C1, C2, C7 and C8 in full-table rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import interference as I
from .operators import sampling as P
from .operators.prototypes import sq_norm
from .plans import fixtures as X
from .plans import rounds as R
from .plans import training as TR
from .session import fresh_dir
from .sources import similarity as S


def _r(c, n=6):
    return F.round(c, n)


def _train(spark, sf):
    return P.split_holdout(X.fv(spark, sf)).where(F.col("split") == "train")


def _similarity(grads, at):
    pairs = I.task_pairs(I.task_order(grads))
    return I.group_cosines(grads, pairs, at).select(*at, "pair", "grp", _r(F.col("similarity")).alias("similarity"))


@query("job_joint_multitask")
def q_job_joint_multitask(spark, sf):
    """Pairwise gradient similarity of all tasks at every step of two epochs."""
    return _similarity(TR.joint_gradients(_train(spark, sf)), ["epoch", "step"])


@query("job_fomaml")
def q_job_fomaml(spark, sf):
    """Query loss and accuracy after one step on the support half, and the size of the mean shared gradient."""
    query_groups, shared = TR.shared_update(_train(spark, sf))
    per_step = query_groups.groupBy("step").agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"))
    size = shared.select("step", sq_norm(F.col("g")).alias("sq_norm"))
    return per_step.join(size, "step").select("step", *[_r(F.col(c)).alias(c) for c in ("loss", "accuracy", "sq_norm")])


@query("job_protomaml")
def q_job_protomaml(spark, sf):
    """Query loss and accuracy of every episode and task after one inner step."""
    _, groups = TR.episode_adaptation(_train(spark, sf), alpha=0.05)
    return groups.select("epoch", "episode", "task", "n", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))


@query("job_protomaml_similarity")
def q_job_protomaml_similarity(spark, sf):
    """Pairwise similarity of the tasks' inner gradients in every episode."""
    inner, _ = TR.episode_adaptation(_train(spark, sf), alpha=0.05)
    return _similarity(TR.gradient_table(inner, ["epoch", "episode"]), ["epoch", "episode"])


@query("job_conflict_study")
def q_job_conflict_study(spark, sf):
    """Two-task conflict study: six per-parameter cosine series by step, also written as wide CSVs (K1)."""
    sims = I.per_param_cosines(TR.conflict_gradients(_train(spark, sf), "t0", "t1", alpha=0.05), "t0", "t1")
    S.write_wide_csv(sims, fresh_dir(spark, "conflict-wide"), [p for p, _ in TR.PARAMS])
    return sims.withColumn("similarity", _r(F.col("similarity")))


def _adapted(spark, sf, inner_steps):
    s = P.split_holdout(X.fv(spark, sf))
    out = TR.adapt_evaluate(s.where(F.col("split") == "train"), s.where(F.col("split") == "val"), alpha=0.05, inner_steps=inner_steps)
    return out.select("task", _r(F.col("accuracy")).alias("accuracy"), _r(F.col("loss")).alias("loss"))


@query("job_adapt_evaluate")
def q_job_adapt_evaluate(spark, sf):
    """C4 with one inner step."""
    return _adapted(spark, sf, 1)


@query("job_adapt_evaluate_zero")
def q_job_adapt_evaluate_zero(spark, sf):
    """C4 without an inner step."""
    return _adapted(spark, sf, 0)


@query("job_protomaml_query_prototypes")
def q_job_protomaml_query_prototypes(spark, sf):
    """C3 with heads built from the query rows' own classes."""
    _, groups = TR.episode_adaptation(_train(spark, sf), alpha=0.05, query_prototypes=True)
    return groups.select("epoch", "episode", "task", "n", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))


def _rounds(history):
    return history.select("round", "task", "n", *[_r(F.col(c)).alias(c) for c in ("loss", "accuracy", "p_norm", "w_norm")])


@query("job_joint_rounds")
def q_job_joint_rounds(spark, sf):
    """C1 with updates: three full-table rounds; loss, accuracy and sizes of the parameters before each and after the last."""
    return _rounds(R.joint_rounds(_train(spark, sf), rounds=3, rate=1.0)[0])


@query("job_fomaml_rounds")
def q_job_fomaml_rounds(spark, sf):
    """C2 with updates: two rounds of two inner steps on half of each task's rows and an outer step by the other half."""
    return _rounds(R.fomaml_rounds(_train(spark, sf), rounds=2, alpha=1.0, beta=1.0, inner_steps=2)[0])


@query("job_train_from_saved_init")
def q_job_train_from_saved_init(spark, sf):
    """Joint rounds that start from the parameters that C2's rounds have stored."""
    train = _train(spark, sf)
    _, start = R.fomaml_rounds(train, rounds=1, alpha=1.0, beta=1.0, inner_steps=1)
    return _rounds(R.joint_rounds(train, rounds=2, rate=1.0, start=start)[0])


@query("job_finetune_sequential")
def q_job_finetune_sequential(spark, sf):
    """From C2's parameters the tasks train one after another; validation before and after the round."""
    s = P.split_holdout(X.fv(spark, sf))
    train, val = s.where(F.col("split") == "train"), s.where(F.col("split") == "val")
    _, start = R.fomaml_rounds(train, rounds=1, alpha=1.0, beta=1.0, inner_steps=1)
    out = R.sequential_rounds(train, val, start, rounds=1, rate=1.0)
    return out.select("round", "task", "n", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))
