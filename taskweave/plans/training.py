"""Gradient and adaptation jobs (C1-C4) as single plans.

The reference trains in a loop whose every step needs the one before.  What its studies look at
-- the gradients of all tasks at common parameters, and what adapting to an episode does -- needs
no loop: at given parameters every step, episode and task is a group of one plan.  Parameters come
from a formula (``weight``) that any engine can compute.

Surrogate model over sentence vectors ``x`` (d values): a shared linear encoder ``P`` (h x d) and a
head ``W`` (C x h), ``b`` (C) for each task.  For a group of n rows with delta = softmax(logits) - onehot(y)

    M = sum delta x^T (C x d),  dW = M P^T / n,  db = sum delta / n,  dP = W^T M / n

so a group's gradients follow from one aggregate (``Summarizer``: partial sums before the shuffle);
rows are never exploded by component and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import interference as I
from ..operators import sampling as P
from ..operators.prototypes import dot, prototypes, sq_norm
from ..session import fresh_dir

HIDDEN = 16
PARAMS = (("encoder.P", 0), ("fc_layer.weight", 1), ("fc_layer.bias", 2))


def weight(name: Column, i: Column, j: Column) -> Column:
    """Parameter value: the first 8 hex digits of md5('name:i:j') as a number between -0.1 and 0.1."""
    key = F.concat_ws(":", name, i.cast("string"), j.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 2001 - 1000) / F.lit(10000.0)


def _matrix(name: Column, rows: Column, cols: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.transform(F.sequence(F.lit(0), cols - 1), lambda j: weight(name, i, j)))


def base_params(rows: DataFrame, hidden: int = HIDDEN) -> DataFrame:
    """``task, P, W, b`` at the formula's values; a task's head has as many classes as the task (A2)."""
    sizes = rows.groupBy("task").agg(F.max(F.size("x")).alias("d"), F.count_distinct("y").cast("int").alias("c"))
    return sizes.select("task", _matrix(F.lit("P"), F.lit(hidden), F.col("d")).alias("P"), _matrix(F.col("task"), F.col("c"), F.lit(hidden)).alias("W"),
                        F.array_repeat(F.lit(0.0), F.col("c")).alias("b"))


def forward(rows: DataFrame) -> DataFrame:
    """Rows with ``x, y, P, W, b`` -> ``delta, loss, ok``."""
    logits = F.transform("W", lambda w, k: dot(w, F.col("__z")) + F.element_at(F.col("b"), k + 1))
    j = rows.withColumn("__z", F.transform("P", lambda r: dot(r, F.col("x")))).withColumn("__l", logits)
    j = j.withColumn("__m", F.array_max("__l")).withColumn("__e", F.transform("__l", lambda v: F.exp(v - F.col("__m"))))
    j = j.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda a, v: a + v))
    delta = F.transform("__e", lambda v, k: v / F.col("__s") - F.when(k == F.col("y"), 1.0).otherwise(0.0))
    return (j.withColumn("delta", delta).withColumn("loss", F.col("__m") + F.log("__s") - F.element_at("__l", F.col("y") + 1))
            .withColumn("ok", ((F.array_position("__l", F.col("__m")) - 1) == F.col("y")).cast("long"))
            .drop("__z", "__l", "__m", "__e", "__s"))


def _combine(weights: Column, rows: Column) -> Column:
    """sum_k weights[k] * rows[k]."""
    first = F.transform(rows[0], lambda v: F.lit(0.0))
    return F.aggregate(F.arrays_zip(weights.alias("w"), rows.alias("r")), first,
                       lambda acc, e: F.zip_with(acc, e["r"], lambda a, v: a + e["w"] * v))


def group_gradients(rows: DataFrame, params: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """``keys``, n, loss, accuracy, ``gP, gW, gb`` of the mean loss, and the parameters they were taken at.

    ``params`` has a row for each ``on``; ``on`` is part of ``keys``.  The rows meet their parameters in an equi-join,
    are reduced to one row for each group, and the groups meet the parameters again, so sums travel, not matrices.
    """
    keys, on = list(keys), list(on)
    f = forward(rows.select(*keys, "y", "x").join(params, on))
    outer = F.flatten(F.transform("delta", lambda dk: F.transform("x", lambda xi: dk * xi)))
    sums = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.avg(F.col("ok").cast("double")).alias("accuracy"),
        vector_to_array(Summarizer.sum(array_to_vector(outer))).alias("__M"), vector_to_array(Summarizer.sum(array_to_vector("delta"))).alias("__g"))
    j = sums.join(params, on)
    d = F.size(F.col("P")[0])
    j = j.withColumn("__M", F.transform("W", lambda _, k: F.transform(F.slice("__M", k * d + 1, d), lambda v: v / F.col("n"))))
    columns = F.transform("P", lambda _, i: F.transform("W", lambda w: F.element_at(w, i + 1)))          # W transposed
    return (j.withColumn("gW", F.transform("__M", lambda m: F.transform("P", lambda p: dot(m, p))))
            .withColumn("gP", F.transform(columns, lambda c: _combine(c, F.col("__M"))))
            .withColumn("gb", F.transform("__g", lambda v: v / F.col("n"))).drop("__M", "__g"))


def descend(groups: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """``keys, P, W, b`` after one gradient step."""
    def matrix(a, g):
        return F.zip_with(a, g, lambda r, s: F.zip_with(r, s, lambda x, y: x - F.lit(alpha) * y))
    return groups.select(*keys, matrix("P", "gP").alias("P"), matrix("W", "gW").alias("W"),
                         F.zip_with("b", "gb", lambda x, y: x - F.lit(alpha) * y).alias("b"))


def gradient_table(groups: DataFrame, at: Sequence[str], scale: float = 1.0, extra: Sequence[str] = ()) -> DataFrame:
    """Gradients in the layout of V5-V9: ``at, task, param, param_ord, chunk, g``."""
    parts = dict(zip((p for p, _ in PARAMS), (F.flatten("gP"), F.flatten("gW"), F.col("gb"))))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(o).alias("param_ord"),
                                        F.transform(parts[p], lambda v: v * F.lit(scale)).alias("g")) for p, o in PARAMS]))
    return groups.select(*at, "task", *extra, rows.alias("r")).select(*at, "task", *extra, "r.param", "r.param_ord", F.lit(0).alias("chunk"), "r.g")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write sampled rows into the shared folder: they are read several times, and sampled once."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", "task", F.col("emotion_ind").alias("y"), "x")


def joint_gradients(rows: DataFrame, epochs: int = 2, batch_size: int = 32, mode: str = "mean_max_min", seed: int = 3) -> DataFrame:
    """Gradients of ``loss / 2`` of every (epoch, step, task) batch of the schedule P7, all at the same parameters."""
    rows = _rows(rows)
    steps = P.multitask_step_schedule(rows, batch_size, epochs=epochs, mode=mode, seed=seed)
    return gradient_table(group_gradients(steps, base_params(rows), ["epoch", "step", "task"], ["task"]), ["epoch", "step"], 0.5)


def shared_update(rows: DataFrame, batch_size: int = 16, alpha: float = 1e-2, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Batches of the shortest schedule, halved (P6): one step on the support half of each task's batch, the query
    half's gradient at the adapted parameters, averaged over the tasks for the shared parameters only (A10).

    Returns (query groups by epoch, step, task; the mean shared gradient by epoch and step).
    """
    rows = _rows(rows)
    halves = _stored(P.batch_support_query(P.multitask_step_schedule(rows, batch_size, epochs=1, mode="zip_shortest", seed=seed)), "halves")
    keys = ["epoch", "step", "task"]
    inner = group_gradients(halves.where("role = 'support'"), base_params(rows), keys, ["task"])
    query = group_gradients(halves.where("role = 'query'"), descend(inner, keys, alpha), keys, keys)
    table = gradient_table(query, ["step"])
    return query, I.accumulate(table, "mean_shared_only")


def prototype_params(episodes: DataFrame, params: DataFrame, num_class: DataFrame, keys: Sequence[str], role: str = "support",
                     on: Sequence[str] = ("task",)) -> DataFrame:
    """V1 on encoder outputs: ``keys, P, W, b`` with heads from the prototypes of ``z = P x`` of the ``role`` rows.
    ``params`` has a row (with the encoder) for each ``on``."""
    keys = list(keys)
    own = episodes.where(F.col("role") == role).withColumnRenamed("y", "emotion_ind")
    means = prototypes(own, keys, num_class, drawn=episodes).select(*keys, F.struct("emotion_ind", "c").alias("m"))
    heads = means.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("__c")).join(params.select(*on, "P"), list(on))   # a row for each class
    z = heads.withColumn("__z", F.transform("__c", lambda m: F.transform("P", lambda p: dot(p, m["c"]))))
    return z.select(*keys, "P", F.transform("__z", lambda r: F.transform(r, lambda v: v * 2.0)).alias("W"), F.transform("__z", lambda r: -sq_norm(r)).alias("b"))


def episode_rows(rows: DataFrame, k: int, epochs: int, seed: int) -> DataFrame:
    ep = P.episode_support_query(P.episode_sampler(rows.select("row_id", "task", "emotion_ind", "x"), k=k, epochs=epochs, seed=seed))
    return _stored(ep.select("epoch", "episode", "task", "role", F.col("emotion_ind").alias("y"), "x"), "episodes")


def first_episode_rows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    ep = P.episode_support_query(P.first_episode(rows.select("row_id", "task", "emotion_ind", "x"), k=k, seed=seed))
    return _stored(ep.select("epoch", "episode", "task", "role", F.col("emotion_ind").alias("y"), "x"), "first-episode")


def num_classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task").agg(F.count_distinct("emotion_ind").alias("num_class"))


def episode_adaptation(rows: DataFrame, k: int = 10, epochs: int = 2, alpha: float = 1e-3, seed: int = 3,
                       query_prototypes: bool = False) -> tuple[DataFrame, DataFrame]:
    """For every (epoch, episode, task) a prototype head, one inner step on the support rows, and the query rows'
    gradient at the adapted parameters.  Returns (inner groups, query groups).

    With ``query_prototypes`` the head is built anew from the query rows' own classes at the adapted encoder before they are scored, as
    the single-head variant does (it sees the labels that it is scored on).
    """
    ep = episode_rows(rows, k, epochs, seed)
    keys = ["epoch", "episode", "task"]
    classes = num_classes(rows)
    inner = group_gradients(ep.where("role = 'support'"), prototype_params(ep, base_params(_rows(rows)), classes, keys), keys, keys)
    adapted = descend(inner, keys, alpha)
    if query_prototypes:
        adapted = prototype_params(ep, adapted, classes, keys, role="query", on=keys)
    return inner, group_gradients(ep.where("role = 'query'"), adapted, keys, keys)


def conflict_gradients(rows: DataFrame, task_1: str, task_2: str, k: int = 10, alpha: float = 1e-3, seed: int = 3) -> DataFrame:
    """Two-task conflict study: draw ``2s`` of the class streams is step s's episode, draw ``2s + 1`` its reference.
    Gradients of both (inner: support, outer: query after one step) in the layout of V7, for ``per_param_cosines``."""
    rows = rows.where(F.col("task").isin(task_1, task_2))
    inner, query = episode_adaptation(rows, k=k, epochs=1, alpha=alpha, seed=seed)
    parts = []
    for phase, groups in (("inner", inner), ("outer", query)):
        kind = F.when(F.col("episode") % 2 == 0, "episode").otherwise("ref")
        g = gradient_table(groups.withColumn("kind", kind).withColumn("phase", F.lit(phase)), ["epoch", "episode"], extra=["phase", "kind"])
        parts.append(g.withColumn("step", F.floor(F.col("episode") / 2).cast("int")))
    return _stored(parts[0].unionByName(parts[1]), "conflict-gradients")


def adapt_evaluate(train: DataFrame, val: DataFrame, k: int = 10, alpha: float = 1e-3, inner_steps: int = 1, batch_size: int = 32,
                   seed: int = 3) -> DataFrame:
    """C4: the first episode adapts each task (prototype head, then 0 or 1 inner step); every validation row is scored.
    ``task, accuracy, loss`` (loss: mean over shuffled batches) and a ``__macro__`` row."""
    ep = first_episode_rows(train, k, seed)
    params = prototype_params(ep, base_params(_rows(train)), num_classes(train), ["task"])
    if inner_steps:
        params = descend(group_gradients(ep.where("role = 'support'"), params, ["task"], ["task"]), ["task"], alpha)
    scored = forward(_rows(val).join(params, "task")).select("row_id", "task", "loss", "ok")
    batches = P.batch_shuffled(scored, batch_size, seed=seed)          # narrow rows only
    per_batch = batches.groupBy("task", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"), F.avg("loss").alias("bl"))
    per_task = per_batch.groupBy("task").agg((F.sum("ok") / F.sum("n")).alias("accuracy"), F.avg("bl").alias("loss"))
    macro = per_task.agg(F.lit("__macro__").alias("task"), F.avg("accuracy").alias("accuracy"), F.avg("loss").alias("loss"))
    return per_task.unionByName(macro)
