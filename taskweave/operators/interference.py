"""Gradient-interference operators.

Gradient table layout: ``step, task, param, param_ord, chunk, g array<double>`` --
one row per (step, task, parameter chunk).  Large parameters are split into
chunks so no row carries a whole model; cosines only need dot products and
squared norms, which are summed per chunk, so nothing is ever concatenated.

Task pairs are generated from an ordered task list (a handful of names) with
array generators, never by joining data to itself on an inequality.  Gradient rows
of the two tasks of a pair are then matched with plain equi-joins on
``(step, param_key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prototypes import dot, sq_norm

GROUPS = ("all_model", "encoder", "fc_layer")


def param_group(param: Column) -> Column:
    """V5: ``fc_layer`` when the parameter name contains it, else ``encoder``."""
    return F.when(param.contains("fc_layer"), F.lit("fc_layer")).otherwise(F.lit("encoder"))


def param_key(param: Column, task: Column) -> Column:
    """Align per-task head parameters by position: drop the ``.<task>.`` name segment."""
    return F.replace(param, F.concat(F.lit("."), task, F.lit(".")), F.lit("."))


def with_groups(grads: DataFrame) -> DataFrame:
    """Each gradient chunk tagged with its group and once more with ``all_model``."""
    return (grads.withColumn("pkey", param_key(F.col("param"), F.col("task")))
            .withColumn("grp", F.explode(F.array(param_group(F.col("param")), F.lit("all_model")))))


def task_order(tasks: DataFrame | Sequence[str], spark=None) -> DataFrame:
    """One-row table ``tasks array<string>`` in list order (sorted when derived from data)."""
    if isinstance(tasks, DataFrame):
        return tasks.select("task").distinct().agg(F.array_sort(F.collect_list("task")).alias("tasks"))
    return spark.createDataFrame([(list(tasks),)], "tasks array<string>")


def task_pairs(order: DataFrame) -> DataFrame:
    """Unordered pairs in list order, ``n(n-1)/2`` rows named ``a-b``."""
    first = order.select("tasks", F.posexplode("tasks").alias("ord_1", "task_1"))
    pairs = first.select("ord_1", "task_1",
                         F.posexplode(F.slice("tasks", F.col("ord_1") + 2, F.size("tasks"))).alias("off", "task_2"))
    return pairs.select("ord_1", "task_1", (F.col("ord_1") + F.col("off") + 1).alias("ord_2"), "task_2",
                        F.concat_ws("-", "task_1", "task_2").alias("pair"))


def concat_layout(grads: DataFrame) -> DataFrame:
    """V5: where each parameter chunk sits in its group's flattened vector.

    Output ``step, task, grp, param, chunk, offset, length, sq_norm`` with offsets in
    parameter order; the window runs over parameter rows of one (step, task, group).
    """
    g = with_groups(grads).withColumn("length", F.size("g")).withColumn("sq_norm", sq_norm(F.col("g")))
    w = (Window.partitionBy("step", "task", "grp").orderBy("param_ord", "chunk")
         .rowsBetween(Window.unboundedPreceding, -1))
    return g.select("step", "task", "grp", "param", "chunk",
                    F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"),
                    "length", "sq_norm")


def _cosine(dotp: Column, n1: Column, n2: Column) -> Column:
    """``u.v / (|u| |v|)``; NaN when either norm is zero (never a division error)."""
    return F.when((n1 == 0) | (n2 == 0), F.lit(float("nan"))).otherwise(dotp / (F.sqrt(n1) * F.sqrt(n2)))


def _nearby(gs: Column) -> Column:
    """Of ``array<struct<task, g>>``: for every two tasks (first name smaller) their dot product and squared norms."""
    known = F.transform(gs, lambda e: F.struct(e["task"].alias("task"), e["g"].alias("g"), sq_norm(e["g"]).alias("n")))
    return F.flatten(F.transform(known, lambda a: F.transform(F.filter(known, lambda b: a["task"] < b["task"]), lambda b: F.struct(
        a["task"].alias("low"), b["task"].alias("high"), dot(a["g"], b["g"]).alias("d"), a["n"].alias("n1"), b["n"].alias("n2")))))


def group_cosines(grads: DataFrame, pairs: DataFrame, at: Sequence[str] = ("step",)) -> DataFrame:
    """V6: per step (columns ``at``), group and task pair: ``1 - cosine_distance`` of the concatenated gradients.

    The tasks' gradients of one parameter chunk meet once, in one group, which gives the dot products of all pairs of
    tasks and their norms (a Gram matrix); so a gradient travels once, not once for each pair.  A group holds a chunk of
    each task.  The sums by parameter group are narrow, and ``all_model`` is the sum of the groups' sums.
    """
    at = list(at)
    chunks = grads.select(*at, "task", param_key(F.col("param"), F.col("task")).alias("pkey"), param_group(F.col("param")).alias("grp"), "chunk", "g")
    gram = chunks.groupBy(*at, "grp", "pkey", "chunk").agg(F.collect_list(F.struct("task", "g")).alias("gs"))
    each = gram.select(*at, "grp", F.explode(_nearby(F.col("gs"))).alias("p")).select(*at, "grp", "p.*")
    sums = each.groupBy(*at, "low", "high", "grp").agg(*[F.sum(c).alias(c) for c in ("d", "n1", "n2")])
    both = (sums.withColumn("grp", F.explode(F.array(F.col("grp"), F.lit("all_model"))))
            .groupBy(*at, "low", "high", "grp").agg(*[F.sum(c).alias(c) for c in ("d", "n1", "n2")]))
    named = pairs.select("pair", "task_1", "task_2", F.least("task_1", "task_2").alias("low"), F.greatest("task_1", "task_2").alias("high"))
    return both.join(named, ["low", "high"]).select(*at, "pair", "task_1", "task_2", "grp", _cosine(F.col("d"), F.col("n1"), F.col("n2")).alias("similarity"))


def per_param_cosines(grads: DataFrame, task_1: str, task_2: str, at: Sequence[str] = ("step",)) -> DataFrame:
    """V7: per step, phase and parameter, three series: ``a_b``, ``a_a`` (vs. reference
    episode of a) and ``b_b``.  ``grads`` carries ``phase`` and ``kind`` (episode/ref)."""
    keys = [*at, "phase", "pkey", "chunk"]
    sides = {"a": (task_1, "episode"), "b": (task_2, "episode"), "ra": (task_1, "ref"), "rb": (task_2, "ref")}
    g = grads.where(F.col("task").isin(task_1, task_2)).withColumn("pkey", param_key(F.col("param"), F.col("task")))
    # the four gradients of a parameter chunk meet once
    met = g.groupBy(*keys).agg(*[F.first(F.when((F.col("task") == t) & (F.col("kind") == k), F.col("g")), ignorenulls=True).alias(n) for n, (t, k) in sides.items()])
    combos = ((f"{task_1}_{task_2}", "a", "b"), (f"{task_1}_{task_1}", "a", "ra"), (f"{task_2}_{task_2}", "b", "rb"))
    u = met.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(name).alias("pair"), dot(F.col(x), F.col(y)).alias("d"), F.when(F.col(y).isNotNull(), sq_norm(F.col(x))).alias("na"),
        F.when(F.col(x).isNotNull(), sq_norm(F.col(y))).alias("nb")) for name, x, y in combos])).alias("c")).select(*keys, "c.*").where("d IS NOT NULL")
    agg = u.groupBy("pair", *at, "phase", "pkey").agg(F.sum("d").alias("d"), F.sum("na").alias("na"),
                                                        F.sum("nb").alias("nb"))
    return agg.select(*at, "phase", "pair", F.col("pkey").alias("param"),
                      _cosine(F.col("d"), F.col("na"), F.col("nb")).alias("similarity"))


def _elementwise(df: DataFrame, keys: Sequence[str], metric: str = "sum") -> DataFrame:
    fn = Summarizer.sum if metric == "sum" else Summarizer.mean
    return df.groupBy(*keys).agg(vector_to_array(fn(array_to_vector(F.col("g")))).alias("g"),
                                 F.count(F.lit(1)).alias("n_rows"))


ACCUMULATE_MODES = ("sum", "mean_shared_only", "shared_sum_head_own")


def accumulate(grads: DataFrame, mode: str = "sum") -> DataFrame:
    """A10: combine per-task gradients per step and parameter.

    ``sum`` -- element-wise sum over tasks; ``mean_shared_only`` -- shared (non head)
    parameters only, divided by the number of tasks of the step;
    ``shared_sum_head_own`` -- shared summed, each task's head keeps its own gradient.
    Output ``step, owner (task or NULL), param, chunk, g``.
    """
    if mode not in ACCUMULATE_MODES:
        raise ValueError(f"mode must be one of {ACCUMULATE_MODES}")
    g = grads.withColumn("pkey", param_key(F.col("param"), F.col("task")))
    shared = param_group(F.col("param")) == "encoder"
    if mode == "sum":
        out = _elementwise(g, ["step", "pkey", "chunk"]).withColumn("owner", F.lit(None).cast("string"))
    elif mode == "mean_shared_only":
        n_tasks = g.groupBy("step").agg(F.count_distinct("task").alias("nt"))
        s = _elementwise(g.where(shared), ["step", "pkey", "chunk"]).join(n_tasks, "step")
        out = (s.withColumn("g", F.transform("g", lambda v: v / F.col("nt")))
               .withColumn("owner", F.lit(None).cast("string")).drop("nt"))
    else:
        s = _elementwise(g.where(shared), ["step", "pkey", "chunk"]).withColumn("owner", F.lit(None).cast("string"))
        own = g.where(~shared).select("step", "pkey", "chunk", "g", F.col("task").alias("owner"))
        out = s.select("step", "pkey", "chunk", "g", "owner").unionByName(own)
    return out.select("step", "owner", F.col("pkey").alias("param"), "chunk", "g")


def _add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _running(siblings) -> Column:
    """``array<struct<at, g>>`` in order of ``at`` -> the same with ``g`` the sum of all up to it and ``before`` the sum before it."""
    zero = F.transform(siblings[0]["g"], lambda _: F.lit(0.0))
    item = F.struct(F.lit(None).cast("long").alias("at"), zero.alias("before"), zero.alias("g"))
    start = F.struct(zero.alias("sum"), F.slice(F.array(item), 1, 0).alias("out"))

    def step(state, e):
        total = _add(state["sum"], e["g"])
        return F.struct(total.alias("sum"), F.concat(state["out"], F.array(F.struct(e["at"].alias("at"), state["sum"].alias("before"), total.alias("g")))).alias("out"))

    return F.aggregate(siblings, start, step)["out"]


def prefix_sums(vectors: DataFrame, keys: Sequence[str], block: int = 32) -> DataFrame:
    """``*keys, at (long), g`` -> the same with ``g`` the sum of all vectors of ``keys`` up to ``at`` (one row for each ``at``, 0 or more).

    A scan in levels: the sums of blocks of ``block`` places are summed in blocks again, until one block is left (up-sweep);
    then each block learns what came before it from the block above (down-sweep).  A group at any level has at most
    ``block`` vectors, so no task holds a whole run, and the levels above the first hold a ``block``-th of it each.
    """
    keys, block = list(keys), max(block, 2)
    levels = [vectors.select(*keys, F.col("at").cast("long").alias("at"), "g")]
    last = vectors.agg(F.max("at")).first()[0] or 0
    while last >= block:
        below = levels[-1]
        levels.append(below.groupBy(*keys, F.floor(F.col("at") / block).cast("long").alias("at"))
                      .agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")))
        last //= block
    before = None
    for level in reversed(levels):
        inner = (level.groupBy(*keys, F.floor(F.col("at") / block).cast("long").alias("__up"))
                 .agg(F.sort_array(F.collect_list(F.struct("at", "g"))).alias("__s"))
                 .select(*keys, "__up", F.explode(_running(F.col("__s"))).alias("r")).select(*keys, "__up", "r.at", "r.before", "r.g"))
        if before is not None:
            inner = inner.join(before, [*keys, "__up"]).withColumns({"before": _add("before", "__above"), "g": _add("g", "__above")}).drop("__above")
        before = inner.select(*keys, F.col("at").alias("__up"), F.col("before").alias("__above"))
        result = inner.select(*keys, "at", "g")
    return result


def parameter_trajectory(theta0: DataFrame, updates: DataFrame, lr: float, block: int = 32) -> DataFrame:
    """V8: ``theta_s = theta_0 - lr * sum_{s' <= s} G_s'`` for every step of ``updates``.

    ``theta0``: ``param, chunk, g`` (initial values); ``updates``: ``step, param, chunk, g``.
    Whole chunks travel, never single elements (see ``prefix_sums``).
    Returns ``step, param, chunk, g`` (the parameter after the step).
    """
    keys = ["param", "chunk"]
    moved = prefix_sums(updates.select(F.col("step").alias("at"), *keys, "g"), keys, block)
    j = moved.join(theta0.select(*keys, F.col("g").alias("__t0")), keys)
    step = F.col("at").cast(updates.schema["step"].dataType).alias("step")
    return j.select(step, *keys, F.zip_with("__t0", "g", lambda t, m: t - F.lit(lr) * m).alias("g"))


def clip_global_norm(grads: DataFrame, max_norm: float = 1.0, keys: Sequence[str] = ("step", "task")) -> DataFrame:
    """V9: scale a step's gradients by ``min(1, max_norm / (|g| + 1e-6))``."""
    keys = list(keys)
    tot = grads.groupBy(*keys).agg(F.sqrt(F.sum(sq_norm(F.col("g")))).alias("total_norm"))
    coef = F.least(F.lit(1.0), F.lit(max_norm) / (F.col("total_norm") + F.lit(1e-6)))
    j = grads.join(tot, keys).withColumn("coef", coef)
    return j.withColumn("g", F.transform("g", lambda v: v * F.col("coef")))


def filter_pair_prefix(sims: DataFrame, anchor: str) -> DataFrame:
    """keep pairs whose name contains ``<anchor>-`` (anchor task first)."""
    return sims.where(F.col("pair").contains(f"{anchor}-"))


def filter_every_nth(df: DataFrame, n: int = 10, step: str = "step") -> DataFrame:
    """keep steps with ``step % n == 0`` (the reference's sampling interval)."""
    return df.where(F.col(step) % n == 0)
