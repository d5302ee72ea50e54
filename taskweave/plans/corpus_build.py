"""Build the canonical multi-task corpus in one plan.

read -> label normalisation -> join -> union -> holdout split -> optional balance
-> text cleaning -> canonical projection.  Cleaning runs after the split/balance
so text is only cleaned for rows that survive; all steps are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import sampling as P
from . import fixtures


def build_corpus(raw: DataFrame, seed: int = 3, test_size: float = 0.3, balance: bool = False,
                 mode: str = T.AS_WRITTEN) -> DataFrame:
    """``raw`` has ``row_id, tweet, emotion, emotion_ind, task`` (and may carry ``split``).

    Rows without a split are divided per task into ``train``/``val``.
    """
    if "split" not in raw.columns:
        raw = P.split_holdout(raw, seed=seed, test_size=test_size)
    if balance:
        raw = P.balance_min_downsample(raw, seed=seed)
    cleaned = raw.withColumn("tweet", T.sanitize("tweet", mode))
    return C.canonical_projection(cleaned, extra=("row_id", "split"))


def corpus_from_tables(spark: SparkSession, sf_dir: str, seed: int = 3, balance: bool = False,
                       mode: str = T.AS_WRITTEN) -> DataFrame:
    raw = fixtures.fd_raw(spark, sf_dir).select("row_id", "tweet", "emotion", "emotion_ind", "task")
    out = build_corpus(raw, seed=seed, balance=balance, mode=mode)
    return out.select("row_id", "tweet", "emotion", "emotion_ind", "task", "split")


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """Flagship summary: rows and mean cleaned length per split, task and class."""
    return (corpus.groupBy("split", "task", "emotion")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.round(F.avg(F.length("tweet")), 6).alias("avg_len"),
                 F.sum(F.length("tweet")).alias("total_len")))
