"""Prototype-head evaluation plans (C5 and the meta-run metric A7).

C5 scores a split with fixed heads once: the reference rescans every task inside a
per-task loop; here one plan scores all tasks, and metrics are two-level aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import prototypes as V
from ..operators import sampling as P


def train_heads(split_rows: DataFrame, split: str = "train") -> DataFrame:
    """Heads (one row per task x class) from the class means of a split."""
    train = split_rows.where(F.col("split") == split)
    protos = V.prototypes(train, ["task"], C.class_cardinality(train))
    return V.proto_heads(protos)


def score_split(split_rows: DataFrame, heads: DataFrame, split: str = "val", batch_size: int = 32,
                seed: int = 3) -> DataFrame:
    """Scored rows of ``split`` with their evaluation batch number."""
    rows = split_rows.where(F.col("split") == split)
    rows = P.batch_shuffled(rows, batch_size, seed=seed, epoch=0)
    return V.score(rows, V.heads_by_task(heads, ["task"]), ["task"])


def evaluate_split(split_rows: DataFrame, batch_size: int = 32, seed: int = 3) -> DataFrame:
    """Per task micro accuracy and batch-mean loss, plus a ``__macro__`` row."""
    scored = score_split(split_rows, train_heads(split_rows), batch_size=batch_size, seed=seed)
    per_task = M.task_metrics(scored)
    macro = M.macro_task_mean(per_task).select(
        F.lit("__macro__").alias("task"), F.col("n_tasks").alias("n"),
        F.col("macro_accuracy").alias("accuracy"), F.col("macro_loss").alias("loss"),
        F.lit(None).cast("long").alias("n_batches"))
    return per_task.select("task", "n", "accuracy", "loss", "n_batches").unionByName(macro)


def episode_scores(rows: DataFrame, k: int = 10, epochs: int = 2, seed: int = 3) -> DataFrame:
    """Per-episode prototype scoring: support builds heads, query rows are scored."""
    ep = P.episode_support_query(P.episode_sampler(rows, k=k, epochs=epochs, seed=seed))
    keys = ["epoch", "episode", "task"]
    support = ep.where(F.col("role") == "support")
    protos = V.prototypes(support, keys, C.class_cardinality(rows), drawn=ep)
    heads = V.heads_by_task(V.proto_heads(protos), keys)
    return V.score(ep.where(F.col("role") == "query"), heads, keys)
