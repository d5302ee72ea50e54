"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables (through the fixtures in ``plans.fixtures``)
over their whole extent.  Doubles that come out of floating-point aggregation are
rounded to 6 decimals so results compare exactly across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .functions import text as T
from .operators import corpus as C
from .operators import sampling as P
from .plans import fixtures as X
from .plans.corpus_build import corpus_from_tables, corpus_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- C0 / flagship --------------------------------------------------------------

@query("corpus_build")
def q_corpus_build(spark, sf):
    return corpus_from_tables(spark, sf)


@query("corpus_build_balanced")
def q_corpus_build_balanced(spark, sf):
    return corpus_from_tables(spark, sf, balance=True)


@query("corpus_summary")
def q_corpus_summary(spark, sf):
    return corpus_summary(corpus_from_tables(spark, sf))


# ---- 2.B normalisation -------------------------------------------------------------

@query("norm_binary_label")
def q_norm_binary_label(spark, sf):
    a, b, c = X.fh(spark, sf)
    lab = a.unionByName(b).unionByName(c)
    num = X.fd_raw(spark, sf).select(F.col("row_id").alias("id"), F.col("label").cast("string").alias("raw"),
                                     L.binary_label(F.col("label"), numeric=True).alias("emotion_ind"),
                                     F.lit("numeric").alias("kind"))
    txt = lab.select(F.col("id").cast("string").alias("id"), F.col("off_label").alias("raw"),
                     L.binary_label("off_label").alias("emotion_ind"), F.lit("string").alias("kind"))
    return num.unionByName(txt)


@query("norm_class_name")
def q_norm_class_name(spark, sf):
    v = X.fv(spark, sf)
    return v.select("row_id", "task", "emotion_ind", L.class_name("emotion_ind", F.col("task")).alias("emotion"))


@query("norm_intensity_class")
def q_norm_intensity_class(spark, sf):
    i = X.fi(spark, sf)
    return i.select("id", "intensity", L.intensity_class("intensity").alias("emotion"))


@query("norm_intensity_split")
def q_norm_intensity_split(spark, sf):
    i = X.fi(spark, sf)
    p = L.intensity_parts("intensity")
    return i.select("id", "intensity", p["ind_text"].alias("ind_text"), p["emotion_ind"].alias("emotion_ind"),
                    p["emo_desc"].alias("emo_desc"), p["n_parts"].alias("n_parts"),
                    (p["n_parts"] != 2).alias("bad_shape"))


@query("norm_ordinal_mode")
def q_norm_ordinal_mode(spark, sf):
    i = X.fi(spark, sf)
    ind = L.intensity_parts("intensity")["emotion_ind"]
    return i.select("id", L.ordinal_or_binary(ind, False).alias("ordinal"),
                    L.ordinal_or_binary(ind, True).alias("binary"))


@query("norm_rename_constant")
def q_norm_rename_constant(spark, sf):
    raw = X.fi(spark, sf).select(F.col("id").alias("ID"), F.col("intensity").alias("Tweet"),
                                 F.col("dimension").alias("Affect Dimension"),
                                 F.col("intensity").alias("Intensity Class"))
    ren = raw.withColumnsRenamed({"ID": "id", "Tweet": "tweet", "Affect Dimension": "emotion"})
    # task takes the dimension before ``emotion`` is overwritten by the class name
    out = ren.withColumn("task", F.col("emotion")).withColumn("emotion", L.intensity_class("Intensity Class"))
    return out.select("id", "tweet", "task", "emotion", F.lit("semeval").alias("source"))


@query("norm_dropna_any")
def q_norm_dropna_any(spark, sf):
    i = X.fi(spark, sf)
    p = L.intensity_parts("intensity")
    t = i.select("id", L.intensity_class("intensity").alias("emotion"), p["emotion_ind"].alias("emotion_ind"))
    return C.dropna_any(t)


@query("norm_canonical_projection")
def q_norm_canonical_projection(spark, sf):
    return C.canonical_projection(X.fd_raw(spark, sf))


# ---- 2.C text ------------------------------------------------------------------------

def _fd_text(spark, sf):
    return X.ft(spark, sf)


def _text_query(fn):
    def q(spark, sf):
        return _fd_text(spark, sf).select("row_id", fn(F.col("tweet")).alias("tweet"))
    return q


QUERIES["txt_strip_emoji"] = _text_query(T.strip_emoji)
QUERIES["txt_strip_emoticon"] = _text_query(lambda c: T.strip_emoticon(c, T.INTENDED))
QUERIES["txt_strip_mention"] = _text_query(T.strip_mention)
QUERIES["txt_strip_hash"] = _text_query(T.strip_hash)
QUERIES["txt_strip_tco"] = _text_query(T.strip_tco)
QUERIES["txt_strip_rt"] = _text_query(T.strip_rt)
QUERIES["txt_strip_url"] = _text_query(T.strip_url)
QUERIES["txt_sanitize"] = _text_query(T.sanitize)
QUERIES["txt_sanitize_intended"] = _text_query(lambda c: T.sanitize(c, T.INTENDED))


# ---- 2.D joins / unions -------------------------------------------------------------

@query("join_inner_id")
def q_join_inner_id(spark, sf):
    docs = X.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tweet"))
    labs = X.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return C.join_inner_id(docs, labs).select("id", F.length("tweet").alias("tweet_len"), "quality", "toxic")


@query("join_label_hierarchy")
def q_join_label_hierarchy(spark, sf):
    a, b, c = X.fh(spark, sf)
    return C.label_hierarchy(a, b, c)


@query("join_hierarchy_violations")
def q_join_hierarchy_violations(spark, sf):
    """J3, the other way round: lower-level labels whose parent label doesn't allow them, or is missing."""
    a, b, c = X.fh(spark, sf)
    off = a.where(F.col("off_label") == "OFF")
    targeted = b.where(F.col("off_label") == "TIN").join(off.select("id"), "id", "left_semi")
    return (C.hierarchy_orphans(off, b).select("id", F.lit("b").alias("level"), F.col("off_label").alias("label"))
            .unionByName(C.hierarchy_orphans(targeted, c).select("id", F.lit("c").alias("level"), F.col("off_label").alias("label"))))


@query("union_all_tasks")
def q_union_all_tasks(spark, sf):
    raw = X.fd_raw(spark, sf)
    parts = [C.canonical_projection(raw.where(F.col("task") == t), extra=("row_id",)) for t in X.FD_TASKS]
    return C.union_all(parts)


# ---- 2.E filters ---------------------------------------------------------------------

@query("filter_task")
def q_filter_task(spark, sf):
    return C.filter_task(corpus_from_tables(spark, sf), "toxic").select("row_id", "task", "emotion_ind", "split")


@query("filter_task_list")
def q_filter_task_list(spark, sf):
    return C.filter_task_list(X.fv(spark, sf), "t3&t0&t4").select("row_id", "task", "ord", "emotion_ind")


# ---- 2.F sampling ----------------------------------------------------------------------

@query("split_holdout")
def q_split_holdout(spark, sf):
    return P.split_holdout(X.fd_raw(spark, sf).select("row_id", "task")).select("row_id", "task", "split")


@query("balance_min_downsample")
def q_balance(spark, sf):
    raw = P.split_holdout(X.fv(spark, sf).select("row_id", "task"))
    return P.balance_min_downsample(raw).select("row_id", "task", "split")


@query("batch_shuffled")
def q_batch_shuffled(spark, sf):
    return P.batch_shuffled(X.fv(spark, sf).select("row_id", "task"), batch_size=32, epoch=1)


@query("episode_sampler")
def q_episode_sampler(spark, sf):
    return P.episode_sampler(X.fv(spark, sf).select("row_id", "task", "emotion_ind"), k=10, epochs=2)


@query("episode_support_query")
def q_episode_support_query(spark, sf):
    ep = P.episode_sampler(X.fv(spark, sf).select("row_id", "task", "emotion_ind"), k=10, epochs=2)
    return P.episode_support_query(ep)


@query("multitask_step_schedule")
def q_multitask_step_schedule(spark, sf):
    return P.multitask_step_schedule(X.fv(spark, sf).select("row_id", "task"), batch_size=16, epochs=2,
                                     mode="mean_max_min")


@query("batch_support_query")
def q_batch_support_query(spark, sf):
    b = P.multitask_step_schedule(X.fv(spark, sf).select("row_id", "task", "emotion_ind"), batch_size=16,
                                  epochs=1, mode="zip_shortest")
    return P.batch_support_query(b)


# ---- 2.G count aggregates -------------------------------------------------------------

@query("agg_value_counts")
def q_agg_value_counts(spark, sf):
    return C.value_counts(corpus_from_tables(spark, sf))


@query("agg_class_cardinality")
def q_agg_class_cardinality(spark, sf):
    return C.class_cardinality(P.split_holdout(X.fv(spark, sf)).where(F.col("split") == "train"))


@query("agg_min_group_size")
def q_agg_min_group_size(spark, sf):
    return C.min_group_size(P.split_holdout(X.fv(spark, sf)))


@query("agg_batch_counts")
def q_agg_batch_counts(spark, sf):
    return C.batch_counts(P.split_holdout(X.fv(spark, sf)), batch_size=32)


# ---- 2.G/2.H prototypes, scoring and metrics ------------------------------------------------

from .operators import metrics as M  # noqa: E402
from .operators import prototypes as V  # noqa: E402
from .plans import evaluate as EV  # noqa: E402


def _r(c, n=6):
    return F.round(c, n)


def _fv_split(spark, sf):
    return P.split_holdout(X.fv(spark, sf))


def _val_scored(spark, sf):
    s = _fv_split(spark, sf)
    return EV.score_split(s, EV.train_heads(s))


@query("agg_prototypes")
def q_agg_prototypes(spark, sf):
    v = X.fv(spark, sf)
    ep = P.episode_support_query(P.episode_sampler(v.select("row_id", "task", "emotion_ind", "x"), k=10, epochs=2))
    protos = V.prototypes(ep.where(F.col("role") == "support"), ["epoch", "episode", "task"],
                          C.class_cardinality(v), drawn=ep)
    return protos.select("epoch", "episode", "task", "emotion_ind", "n_support",
                         F.posexplode("c").alias("i", "c")).withColumn("c", _r(F.col("c")))


@query("agg_prototypes_one_shot")
def q_agg_prototypes_one_shot(spark, sf):
    """A9 with one row per class and episode: the half that is support is empty, so all prototypes are NaN."""
    v = X.fv(spark, sf)
    ep = P.episode_support_query(P.episode_sampler(v.select("row_id", "task", "emotion_ind", "x"), k=1, epochs=1))
    protos = V.prototypes(ep.where(F.col("role") == "support"), ["epoch", "episode", "task"],
                          C.class_cardinality(v), drawn=ep)
    return protos.select("epoch", "episode", "task", "emotion_ind", "n_support",
                         F.size(F.filter("c", lambda e: F.isnan(e))).alias("n_nan"))


@query("proto_head")
def q_proto_head(spark, sf):
    h = EV.train_heads(_fv_split(spark, sf))
    return h.select("task", "emotion_ind", _r(F.col("b")).alias("b"), F.posexplode("w").alias("i", "w")) \
        .withColumn("w", _r(F.col("w")))


@query("proto_logits")
def q_proto_logits(spark, sf):
    s = _val_scored(spark, sf)
    return s.select("row_id", "task", F.posexplode("logits").alias("k", "logit")).withColumn("logit", _r(F.col("logit")))


@query("predict_argmax")
def q_predict_argmax(spark, sf):
    return _val_scored(spark, sf).select("row_id", "task", "emotion_ind", "pred")


@query("loss_cross_entropy")
def q_loss_cross_entropy(spark, sf):
    return _val_scored(spark, sf).select("row_id", "task", _r(F.col("loss")).alias("loss"))


@query("agg_accuracy_micro")
def q_agg_accuracy_micro(spark, sf):
    return M.accuracy_micro(_val_scored(spark, sf)).withColumn("accuracy", _r(F.col("accuracy")))


@query("agg_loss_batch_mean")
def q_agg_loss_batch_mean(spark, sf):
    return M.loss_batch_mean(_val_scored(spark, sf)).withColumn("loss", _r(F.col("loss")))


@query("agg_accuracy_batch_mean")
def q_agg_accuracy_batch_mean(spark, sf):
    sc = EV.episode_scores(X.fv(spark, sf).select("row_id", "task", "emotion_ind", "x"))
    out = M.accuracy_batch_mean(sc, ["epoch", "episode", "task"])
    return out.select("n_episodes", _r(F.col("accuracy")).alias("accuracy"), _r(F.col("loss")).alias("loss"))


@query("agg_macro_task_mean")
def q_agg_macro_task_mean(spark, sf):
    sc = _val_scored(spark, sf)
    per_task = M.accuracy_micro(sc).join(M.loss_batch_mean(sc), "task")
    out = M.macro_task_mean(per_task)
    return out.select("n_tasks", _r(F.col("macro_accuracy")).alias("macro_accuracy"),
                      _r(F.col("macro_loss")).alias("macro_loss"))


@query("job_evaluate_split")
def q_job_evaluate_split(spark, sf):
    out = EV.evaluate_split(_fv_split(spark, sf))
    return out.withColumn("accuracy", _r(F.col("accuracy"))).withColumn("loss", _r(F.col("loss")))
