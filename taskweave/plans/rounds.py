"""Training in full-table rounds.

A round is one pass over all training rows at fixed parameters: every partition sums its rows' gradients
(``training.group_gradients``: map-side sums, one row for each task), then the parameters move once.  A run has a fixed number
of rounds, not a job for each batch.  What a round found -- losses, gradients and the parameters they were taken at, one row
for each task -- is stored in the run's folder, so lineage doesn't grow, and a run that is started again in the same
folder goes on behind its last whole round.

The parameters are those of ``training``: a shared encoder ``P`` and a head ``W, b`` for each task.  Every task's row carries
the same ``P``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prototypes import sq_norm
from ..operators.ranking import draw_key, within_k_smallest
from ..session import fresh_dir
from . import training as TR

ROUND = ("task", "n", "loss", "accuracy", "gP", "gW", "gb", "P", "W", "b")


def _kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The table stored at ``path``; what ``make()`` gives is stored there first, unless a whole table is there already."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _moved(matrix, change, rate) -> Column:
    return F.zip_with(matrix, change, lambda r, s: F.zip_with(r, s, lambda x, y: x - F.lit(rate) * y))


def shared_step(groups: DataFrame, rate: float) -> DataFrame:
    """``task, P``: the encoder after a step against the sum of all tasks' gradients (``task, P, gP``, a row for each task)."""
    total = groups.agg(vector_to_array(Summarizer.sum(array_to_vector(F.flatten("gP")))).alias("__sum")).withColumn("__one", F.lit(1))
    j = groups.select("task", "P", F.lit(1).alias("__one")).join(total, "__one")
    d = F.size(F.col("P")[0])
    rows = F.transform("P", lambda _, i: F.slice("__sum", i * d + 1, d))
    return j.select("task", _moved("P", rows, rate).alias("P"))


def own_step(groups: DataFrame, rate: float) -> DataFrame:
    """``task, W, b``: each head after a step against its own gradient."""
    return groups.select("task", _moved("W", "gW", rate).alias("W"), F.zip_with("b", "gb", lambda x, y: x - F.lit(rate) * y).alias("b"))


def _history(tables: Sequence[DataFrame]) -> DataFrame:
    """``round, task, n, loss, accuracy, p_norm, w_norm`` (squared norms of the parameters the round began with)."""
    norm = lambda c: sq_norm(F.flatten(F.col(c)))
    parts = [t.select(F.lit(r).alias("round"), "task", "n", "loss", "accuracy", norm("P").alias("p_norm"), norm("W").alias("w_norm"))
             for r, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_rounds(rows: DataFrame, rounds: int = 2, rate: float = 0.5, start: DataFrame | None = None,
                 folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All tasks' gradients of ``loss / 2`` at common parameters, then one update: the encoder by their sum, each head by
    its own.  C7 with ``start`` (``task, P, W, b``), for instance what ``fomaml_rounds`` returns.

    Returns the history (``rounds`` + 1 rows for each task: before each round, and after the last) and the parameters.
    """
    spark, rows = rows.sparkSession, TR._rows(rows)
    folder = folder or fresh_dir(spark, "joint-rounds")
    params, tables = TR.base_params(rows) if start is None else start, []
    for r in range(rounds + 1):
        at = params
        found = _kept(spark, f"{folder}/round-{r}", lambda: TR.group_gradients(rows, at, ["task"], ["task"]).select(*ROUND))
        tables.append(found)
        params = found.select("task", "P", "W", "b")
        if r < rounds:
            params = shared_step(found, rate / 2).join(own_step(found, rate / 2), "task")
    return _history(tables), params


def zero_heads(params: DataFrame) -> DataFrame:
    return params.select("task", "P", F.transform("W", lambda w: F.transform(w, lambda v: F.lit(0.0))).alias("W"),
                         F.transform("b", lambda v: F.lit(0.0)).alias("b"))


def halves(rows: DataFrame, r: int, seed: int = 3) -> DataFrame:
    """Rows with ``support``: half (rounded down) of each task's rows, another half in every round."""
    keyed = rows.withColumn("__key", draw_key(seed, f"half{r}", "row_id"))
    return within_k_smallest(keyed, ["task"], "__key", "row_id", lambda c: c.withColumn("__k", F.floor(F.col("__tot") / 2)), "support").drop("__key")


def fomaml_rounds(rows: DataFrame, rounds: int = 2, alpha: float = 0.5, beta: float = 0.5, inner_steps: int = 2, seed: int = 3,
                  folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every task copies the parameters with a zero head, takes ``inner_steps`` steps of rate ``alpha`` on its support half, and the query
    half's gradient at the adapted copy moves the common encoder by ``beta`` times the mean over the tasks (first order).

    Returns the history (loss and accuracy of the query half at the adapted copy, whose norms are given too) and the
    parameters after the last round: the encoder, heads zero.
    """
    spark, rows = rows.sparkSession, TR._rows(rows)
    folder = folder or fresh_dir(spark, "fomaml-rounds")
    params, tables = zero_heads(TR.base_params(rows)), []
    n_tasks = rows.select("task").distinct().count()
    for r in range(rounds):
        at = params

        def adapted():
            split, inner = halves(rows, r, seed), at
            for _ in range(inner_steps):
                inner = TR.descend(TR.group_gradients(split.where("support"), inner, ["task"], ["task"]), ["task"], alpha)
            query = TR.group_gradients(split.where("NOT support"), inner, ["task"], ["task"])
            return query.select(*ROUND).join(at.select("task", F.col("P").alias("P0"), F.col("W").alias("W0"), F.col("b").alias("b0")), "task")

        found = _kept(spark, f"{folder}/round-{r}", adapted)
        tables.append(found)
        outer = found.select("task", F.col("P0").alias("P"), "gP")
        heads = found.select("task", F.col("W0").alias("W"), F.col("b0").alias("b"))
        params = shared_step(outer, beta / max(n_tasks, 1)).join(heads, "task")
    return _history(tables), _kept(spark, f"{folder}/parameters", lambda: params)


def clipped(groups: DataFrame, max_norm: float) -> DataFrame:
    """V9 on whole groups: gradients scaled by ``min(1, max_norm / (|g| + 1e-6))``."""
    norm = F.sqrt(sq_norm(F.flatten("gP")) + sq_norm(F.flatten("gW")) + sq_norm(F.col("gb")))
    c = F.least(F.lit(1.0), F.lit(max_norm) / (norm + F.lit(1e-6)))
    g = groups.withColumn("__c", c)
    both = {n: F.transform(n, lambda r: F.transform(r, lambda v: v * F.col("__c"))) for n in ("gP", "gW")}
    return g.withColumns({**both, "gb": F.transform("gb", lambda v: v * F.col("__c"))}).drop("__c")


def sequential_rounds(train: DataFrame, val: DataFrame, start: DataFrame, rounds: int = 1, rate: float = 0.5, max_norm: float = 1.0,
                      folder: str | None = None) -> DataFrame:
    """From ``start`` (C2's parameters) with all heads zero, the tasks train one after another, in order of their names:
    each takes one clipped step (V9) of the encoder and its head over all its rows, at the parameters that the task before left.

    Validation before the first and after every round: ``round, task, n, loss, accuracy``, of which ``best_epoch`` (W4) takes the best.
    """
    spark, train, val = train.sparkSession, TR._rows(train), TR._rows(val)
    folder = folder or fresh_dir(spark, "sequential-rounds")
    params, scores = zero_heads(start), []
    tasks = [t["task"] for t in start.select("task").orderBy("task").collect()]     # a few names
    for r in range(rounds + 1):
        at = params
        scored = TR.forward(val.join(at, "task")).groupBy("task").agg(
            F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
        scores.append(_kept(spark, f"{folder}/scores-{r}", lambda: scored).select(F.lit(r).alias("round"), "task", "n", "loss", "accuracy"))
        for i, task in enumerate(tasks if r < rounds else ()):
            before = params

            def stepped():
                one = clipped(TR.group_gradients(train.where(F.col("task") == task), before.where(F.col("task") == task), ["task"], ["task"]), max_norm)
                encoder = one.select(F.lit(1).alias("__one"), _moved("P", "gP", rate).alias("__P"))
                heads = own_step(one, rate).unionByName(before.where(F.col("task") != task).select("task", "W", "b"))
                return heads.withColumn("__one", F.lit(1)).join(encoder, "__one").select("task", F.col("__P").alias("P"), "W", "b")

            params = _kept(spark, f"{folder}/round-{r}-{i}", stepped)
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out
