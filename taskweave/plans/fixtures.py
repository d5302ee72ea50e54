"""Canonical inputs derived by Spark from the driver tables.

Every fixture reads the given parquet tables, so its work grows with them.

* FD -- labelled corpus: documents joined to labels, one row per (document, task).
* FV -- sentence vectors with tasks and classes (embeddings).
* FS -- step-indexed series (events).
* FM -- per-epoch metric history (FS re-shaped).
* FI -- intensity strings (events) plus the parser's edge cases.
* FH -- three-level offensive labels (labels) plus two invalid rows.
* FG -- gradient table (FV aggregated per step and task).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators.ranking import bucketed_rank
from ..session import read_table

# Fixed values of the fixtures.
FD_TASKS = ("quality", "toxic")
FI_EMOTIONS = ("sadness", "joy", "anger", "fear", "calm")  # 'calm' names no emotion
FI_EDGE_CASES = ("10: joy", ": fear", "2: a: b", None)
FH_LEVEL_C = ("IND", "GRP", "OTH")
FM_SLOTS = (("train", "accuracy"), ("train", "loss"), ("val", "accuracy"), ("val", "loss"))
FS_BUCKET_SECONDS = 60
#: Emoji: plain, text style, with a variation selector, keycap, flag, family, skin tone, tag sequence; then look-alikes.
EMOJI_CASES = ("\U0001F600", "\u2122", "\u00a9", "\u203c\ufe0f", "\u2194", "\u25b6\ufe0f", "\u3030", "1\ufe0f\u20e3", "\U0001F1E9\U0001F1EA",
               "\U0001F468\u200d\U0001F469\u200d\U0001F467", "\U0001F44D\U0001F3FD", "\u2764\ufe0f",
               "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F",
               "\u2713", "\u2610", "\u2776", "1", "#", "*", "\u00e9", "\u4e2d")


def fd_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FD before cleaning: ``row_id, doc_id, tweet, label, emotion_ind, emotion, task``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labs, "doc_id", "inner")                      # J2
    long = joined.unpivot(["doc_id", "text"], list(FD_TASKS), "task", "label")  # U1 of one wide source
    ind = L.binary_label(F.col("label"), numeric=True)
    return long.select(
        F.concat(F.col("task"), F.lit(":"), F.col("doc_id").cast("string")).alias("row_id"),
        "doc_id",
        T.decorate("text", "doc_id").alias("tweet"),
        F.col("label").cast("int").alias("label"),
        ind.alias("emotion_ind"),
        L.class_name(ind, F.col("task")).alias("emotion"),
        "task",
    )


def ft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT: ``row_id, doc_id, tweet`` -- every document once, with one emoji (or look-alike) case after the decoration."""
    docs = read_table(spark, sf_dir, "documents")
    case = F.element_at(F.array(*[F.lit(x) for x in EMOJI_CASES]), (F.col("doc_id") % len(EMOJI_CASES)).cast("int") + 1)
    return docs.select(F.col("doc_id").cast("string").alias("row_id"), "doc_id",
                       F.concat(T.decorate("text", "doc_id"), F.lit(" "), case).alias("tweet"))


def fv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FV: ``row_id, vec_id, task, emotion_ind, emotion, x array<double>``."""
    e = read_table(spark, sf_dir, "embeddings")
    task = F.concat(F.lit("t"), F.floor(F.col("label") / 2).cast("string"))
    ind = (F.col("label") % 2).cast("int")
    return e.select(
        F.col("vec_id").cast("string").alias("row_id"),
        "vec_id",
        task.alias("task"),
        ind.alias("emotion_ind"),
        L.class_name(ind, task).alias("emotion"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FS: ``series, idx (0-based), value, ts, event_id`` ordered by ``(ts, event_id)``.

    The position is an exact rank computed per minute, so no series is ever
    sorted in a single task.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (FS_BUCKET_SECONDS * 1_000_000))
    ranked = bucketed_rank(ev, ["event_type"], bucket, [F.col("ts"), F.col("event_id")], "rk")
    return ranked.select(F.col("event_type").alias("series"), (F.col("rk") - 1).alias("idx"),
                         "value", "ts", "event_id")


def fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM: metric history ``run, split, task, epoch, name, value`` from FS."""
    s = fs(spark, sf_dir)
    slot = (F.col("idx") % len(FM_SLOTS)).cast("int")
    split = F.element_at(F.array(*[F.lit(a) for a, _ in FM_SLOTS]), slot + 1)
    name = F.element_at(F.array(*[F.lit(b) for _, b in FM_SLOTS]), slot + 1)
    value = F.when(name == "accuracy", F.col("value") % 1).otherwise(F.col("value"))
    return s.select(F.lit("fs").alias("run"), split.alias("split"), F.col("series").alias("task"),
                    (F.col("idx") / len(FM_SLOTS)).cast("long").alias("epoch"),
                    name.alias("name"), value.alias("value"))


def fi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI: ``id, emotion (task), intensity`` -- intensity strings with edge cases."""
    ev = read_table(spark, sf_dir, "events").select("event_id")
    emo = F.element_at(F.array(*[F.lit(x) for x in FI_EMOTIONS]),
                       (F.col("event_id") % len(FI_EMOTIONS)).cast("int") + 1)
    base = ev.select(
        F.col("event_id").cast("string").alias("id"),
        emo.alias("dimension"),
        F.concat((F.col("event_id") % 4).cast("string"), F.lit(": amount of "), emo).alias("intensity"),
    )
    edge = spark.createDataFrame(
        [(f"edge{i}", "joy", v) for i, v in enumerate(FI_EDGE_CASES)],
        "id string, dimension string, intensity string")
    return base.unionByName(edge)


def fh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FH: level A, B, C label tables ``(id, off_label)`` derived from ``labels``.

    Two invalid rows are added: a level-B label for a NOT id (smallest such id)
    and a level-C label for an UNT id (smallest such id).
    """
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    a = lab.select(F.col("doc_id").alias("id"),
                   F.when(F.col("toxic") == 1, "OFF").otherwise("NOT").alias("off_label"))
    b_valid = lab.where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "TIN").otherwise("UNT").alias("off_label"))
    b_bad = lab.where(F.col("toxic") == 0).agg(F.min("doc_id").alias("id")) \
        .where(F.col("id").isNotNull()).select("id", F.lit("TIN").alias("off_label"))
    c_valid = lab.where((F.col("toxic") == 1) & (F.col("quality") == 1)).select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in FH_LEVEL_C]), (F.col("doc_id") % 3).cast("int") + 1)
        .alias("off_label"))
    c_bad = lab.where((F.col("toxic") == 1) & (F.col("quality") == 0)).agg(F.min("doc_id").alias("id")) \
        .where(F.col("id").isNotNull()).select("id", F.lit("IND").alias("off_label"))
    return a, b_valid.unionByName(b_bad), c_valid.unionByName(c_bad)


# ---- FG: gradient table -------------------------------------------------------
#: Rows of a step: the number of steps grows with the data.
FG_STEP_ROWS = 20
FG_PARAMS = (("encoder.P", 0), ("fc_layer.weight", 1), ("fc_layer.bias", 2))
FG_ZERO_TASK = "tz"


def _fg_grads(v: DataFrame, keys: list[str]) -> DataFrame:
    """Per-group parameter gradients in one aggregate (no per-element rows).

    ``encoder.P`` = sum of (2*emotion_ind - 1) * x, ``fc_layer.weight`` = sum of x, ``fc_layer.bias`` = [count, sum of emotion_ind].  Vector
    sums use ``Summarizer`` (JVM, map-side partial aggregation); the three
    parameters are then unpivoted into rows.
    """
    sign = (F.col("emotion_ind") * 2 - 1).cast("double")
    agg = v.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.transform("x", lambda e: e * sign)))).alias("p0"),
        vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("p1"),
        F.array(F.count(F.lit(1)).cast("double"), F.sum("emotion_ind").cast("double")).alias("p2"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("param"), F.lit(o).alias("param_ord"),
                                        F.col(f"p{o}").alias("g")) for name, o in FG_PARAMS]))
    out = agg.select(*keys, rows.alias("r"))
    return out.select(*keys, "r.param", "r.param_ord", F.lit(0).alias("chunk"), "r.g")


def fg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FG: ``step, task, param, param_ord, chunk, g array<double>``.

    Includes task ``tz`` at step 0 with all-zero gradients (forces NaN cosines).
    """
    v = fv(spark, sf_dir).withColumn("step", F.floor(F.col("vec_id") / FG_STEP_ROWS).cast("int"))
    grads = _fg_grads(v, ["step", "task"])
    zero = (grads.where((F.col("step") == 0))
            .groupBy("step", "param", "param_ord", "chunk")
            .agg(F.max(F.size("g")).alias("n"))
            .select("step", F.lit(FG_ZERO_TASK).alias("task"), "param", "param_ord", "chunk",
                    F.array_repeat(F.lit(0.0), F.col("n")).alias("g")))
    return grads.unionByName(zero)


def fg_phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FG with ``phase`` (inner/outer) and ``kind`` (episode/ref) for per-parameter study."""
    v = (fv(spark, sf_dir)
         .withColumn("step", F.floor(F.col("vec_id") / (4 * FG_STEP_ROWS)).cast("int"))
         .withColumn("phase", F.when(F.col("vec_id") % 2 == 0, "inner").otherwise("outer"))
         .withColumn("kind", F.when(F.floor(F.col("vec_id") / 2) % 2 == 0, "episode").otherwise("ref")))
    return _fg_grads(v, ["step", "task", "phase", "kind"])
