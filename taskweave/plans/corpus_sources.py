"""C0 from files: the four families of labelled texts, each through its own loader, into one corpus with three splits.

* headed CSV with a label column (S1): training and test file, validation drawn from training (P1);
* text and gold labels in separate files joined by id (S1, S2, J2): training file, test files, validation drawn (P1);
* one file for each emotion and split (S5, N3-N7): all three splits given;
* text and label lines joined by position (S3, J1): all three splits given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import corpus as C
from ..operators import sampling as P
from ..sources import delimited as D
from ..sources import lines as LN

GIVEN_SPLITS = {"train": "train", "dev": "val", "test-gold": "test"}


def _labelled(df: DataFrame, task: str, row_id, label) -> DataFrame:
    ind = L.binary_label(label, numeric=True)
    return df.select(F.concat(F.lit(f"{task}:"), row_id).alias("row_id"), "tweet", ind.alias("emotion_ind"),
                     L.class_name(ind, F.lit(task)).alias("emotion"), F.lit(task).alias("task"))


def _with_holdout(train: DataFrame, test: DataFrame) -> DataFrame:
    return P.split_holdout(train).unionByName(test.withColumn("split", F.lit("test")))


def load_headed(spark: SparkSession, train: str, test: str, task: str) -> DataFrame:
    schema = "id STRING, tweet STRING, label INT"
    parts = [_labelled(D.read_delimited(spark, p, schema, multi_line=True), task, F.col("id"), F.col("label")) for p in (train, test)]
    return _with_holdout(*parts)


def load_by_id(spark: SparkSession, train: str, test_text: str, test_labels: str, task: str) -> DataFrame:
    kept = D.read_delimited(spark, train, "id STRING, tweet STRING, label INT", sep="\t", multi_line=True)
    text = D.read_delimited(spark, test_text, "id STRING, tweet STRING", sep="\t", multi_line=True)
    gold = D.read_delimited(spark, test_labels, "id STRING, label INT", header=False)
    test = C.join_inner_id(text, gold)
    return _with_holdout(*[_labelled(df, task, F.col("id"), F.col("label")) for df in (kept, test)])


def load_emotions(spark: SparkSession, base: str) -> DataFrame:
    """Files ``EI-oc-En-<emotion>-<split>``; a class is the intensity's text, rows that name no emotion are dropped."""
    schema = "ID STRING, Tweet STRING, `Affect Dimension` STRING, `Intensity Class` STRING"
    raw = D.read_with_provenance(spark, base, schema, r"EI-oc-En-([a-z]+)-(train|dev|test-gold)", ["task", "given"])
    ind = L.ordinal_or_binary(L.intensity_parts("Intensity Class")["emotion_ind"], True)
    split = F.element_at(F.create_map(*[F.lit(x) for kv in GIVEN_SPLITS.items() for x in kv]), F.col("given"))
    rows = raw.select(F.concat(F.lit("ei:"), "ID").alias("row_id"), F.col("Tweet").alias("tweet"), ind.alias("emotion_ind"),
                      L.intensity_class("Intensity Class").alias("emotion"), "task", split.alias("split"))
    return C.dropna_any(rows)


def load_lines(spark: SparkSession, files: dict[str, tuple[str, str]], task: str) -> DataFrame:
    parts = []
    for split, (text, labels) in files.items():
        rows = LN.join_positional(LN.read_lines_positional(spark, text, skip_blank=False, col="tweet"),
                                  LN.read_lines_positional(spark, labels, skip_blank=True, col="label")
                                  .withColumn("label", F.col("label").cast("int")))
        row_id = F.concat(F.lit(f"{split}:"), F.col("pos").cast("string"))
        parts.append(_labelled(rows, task, row_id, F.col("label")).withColumn("split", F.lit(split)))
    return C.union_all(parts)


def build_from_sources(families: list[DataFrame], balance: bool = False, mode: str = T.AS_WRITTEN) -> DataFrame:
    """All families in one corpus; P2 if wanted; each text is cleaned once."""
    rows = C.union_all([f.select("row_id", "tweet", "emotion", "emotion_ind", "task", "split") for f in families])
    if balance:
        rows = P.balance_min_downsample(rows)
    return rows.withColumn("tweet", T.sanitize("tweet", mode))
