"""Registered queries for file sources and sinks (2.A, 2.D J1, 2.J).

Each query writes its input files from the driver tables with Spark's writers
into a fresh folder under the session's shared checkpoint location, then reads
them back through the source operator -- the round trip is what is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import interference as I
from .functions import text as T
from .plans import corpus_sources as CS
from .plans import fixtures as X
from .session import fresh_dir
from .sources import delimited as D
from .sources import lines as LN
from .sources import series_json
from .sources import similarity as S

# Fixed values of the line-file fixture: positions replaced by special lines.
LINE_SPECIALS = ((7, ""), (13, '"'), (21, "NA"))
LINE_PERIOD = 50


@query("src_csv_header")
def q_src_csv_header(spark, sf):
    rows = X.ft(spark, sf).select("row_id", "tweet", F.length("tweet").alias("label"))
    out = []
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        path = fresh_dir(spark, f"fd-{fmt}")
        D.write_delimited(rows, path, header=True, sep=sep)
        back = D.read_delimited(spark, path, "row_id STRING, tweet STRING, label INT", header=True, sep=sep, multi_line=True)
        out.append(back.withColumn("fmt", F.lit(fmt)))
    return out[0].unionByName(out[1])


@query("src_csv_headerless")
def q_src_csv_headerless(spark, sf):
    a, _, _ = X.fh(spark, sf)
    path = fresh_dir(spark, "fh-a")
    D.write_delimited(a, path, header=False)
    return D.read_delimited(spark, path, "id BIGINT, off_label STRING", header=False)


def _line_files(spark, sf):
    rows = X.ft(spark, sf).select("doc_id", "tweet", (F.col("doc_id") % 2).cast("int").alias("emotion_ind"))
    special = None
    for k, v in LINE_SPECIALS:
        cond = F.col("doc_id") % LINE_PERIOD == k
        special = F.when(cond, F.lit(v)) if special is None else special.when(cond, F.lit(v))
    flat = F.regexp_replace("tweet", "[\r\n]", " ")
    rows = rows.withColumn("line", special.otherwise(flat))
    text_path, label_path = fresh_dir(spark, "lines-text"), fresh_dir(spark, "lines-labels")
    LN.write_lines(rows, text_path, "doc_id", "line")
    last = rows.agg(F.max("doc_id").alias("last"))
    labels = rows.join(last, F.col("doc_id") == F.col("last"), "left_anti")
    LN.write_lines(labels, label_path, "doc_id", "emotion_ind")
    text = LN.read_lines_positional(spark, text_path, skip_blank=False, col="tweet")
    labs = (LN.read_lines_positional(spark, label_path, skip_blank=True, col="emotion_ind")
            .withColumn("emotion_ind", F.col("emotion_ind").cast("int")))
    return text, labs


@query("src_lines_positional")
def q_src_lines_positional(spark, sf):
    text, _ = _line_files(spark, sf)
    return text


@query("join_positional")
def q_join_positional(spark, sf):
    text, labs = _line_files(spark, sf)
    return LN.join_positional(text, labs)


def _sims_long(spark, sf):
    g = X.fg(spark, sf)
    sims = I.group_cosines(g, I.task_pairs(I.task_order(g)))
    return sims.withColumn("idx", F.col("step").cast("long"))


@query("sink_similarity_json")
def q_sink_similarity_json(spark, sf):
    path = fresh_dir(spark, "similarity-json")
    S.write_similarity_json(_sims_long(spark, sf), path)
    # the raw values are checked too: NaN must be a bare token
    tokens = series_json.read_tokens(spark, path)
    number = F.when(~F.col("token").isin("NaN", '"NaN"'), F.col("token").cast("double"))
    cols = []
    for g in S.GROUPS:
        mine = F.col("grp") == g
        cols += [F.count(F.when(mine, F.lit(1))).cast("int").alias(f"n_{g}"), F.round(F.coalesce(F.sum(F.when(mine, number)), F.lit(0.0)), 6).alias(f"sum_{g}")]
    return tokens.groupBy("pair").agg(*cols, F.count(F.when(F.col("token") == "NaN", F.lit(1))).cast("int").alias("n_bare_nan"),
                                      F.count(F.when(F.col("token") == '"NaN"', F.lit(1))).cast("int").alias("n_quoted_nan"))


@query("src_similarity_json")
def q_src_similarity_json(spark, sf):
    path = fresh_dir(spark, "similarity-json")
    S.write_similarity_json(_sims_long(spark, sf), path)
    back = S.read_similarity_json(spark, path)
    return back.select("pair", "grp", F.col("idx").cast("long"), F.round("similarity", 6).alias("similarity"))


@query("src_multi_file_provenance")
def q_src_multi_file_provenance(spark, sf):
    fi = X.fi(spark, sf).where(F.col("id").rlike("^[0-9]+$"))
    split = F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test-gold")),
                         (F.col("id").cast("long") % 3).cast("int") + 1)
    rows = fi.select(F.col("id").alias("ID"), F.concat(F.lit("tweet "), F.col("id")).alias("Tweet"),
                     F.col("dimension").alias("Affect Dimension"), F.col("intensity").alias("Intensity Class"),
                     F.concat(F.lit("EI-oc-En-"), F.col("dimension"), F.lit("-"), split).alias("stem"))
    base = fresh_dir(spark, "semeval")
    (rows.write.mode("overwrite").partitionBy("stem").option("header", True).option("sep", "\t")
     .option("quote", '"').option("escape", '"').csv(base))
    schema = "ID STRING, Tweet STRING, `Affect Dimension` STRING, `Intensity Class` STRING"
    back = D.read_with_provenance(spark, base, schema, r"EI-oc-En-([a-z]+)-(train|dev|test-gold)", ["task", "split"])
    return back.select(F.col("ID").alias("id"), F.col("Tweet").alias("tweet"), "task", "split",
                       F.col("Affect Dimension").alias("emotion"), F.col("Intensity Class").alias("intensity"))


@query("sink_wide_csv")
def q_sink_wide_csv(spark, sf):
    sims = I.per_param_cosines(X.fg_phased(spark, sf), "t0", "t1")
    params = [p for p, _ in X.FG_PARAMS]
    path = fresh_dir(spark, "wide-csv")
    S.write_wide_csv(sims, path, params)
    back = S.read_wide_csv(spark, path, params)
    return back.select(F.col("step").cast("int"), "phase", "pair", "param",
                       F.round("similarity", 6).alias("similarity")).where(F.col("similarity").isNotNull())


@query("sink_metric_scalars")
def q_sink_metric_scalars(spark, sf):
    path = fresh_dir(spark, "scalars")
    S.write_metric_scalars(X.fm(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("run", "tag", "step", F.round("value", 6).alias("value"))


@query("corpus_build_sources")
def q_corpus_build_sources(spark, sf):
    """C0 through all loaders: the documents and events are written as the four families' files, then read back."""
    docs = X.ft(spark, sf).select(F.col("doc_id").alias("id"), "tweet", (F.col("doc_id") % 3).cast("int").alias("label"))
    test = F.col("id") % 5 == 0
    paths = {n: fresh_dir(spark, f"sources-{n}") for n in ("a-train", "a-test", "b-train", "b-text", "b-gold", "ei")}
    D.write_delimited(docs.where(~test), paths["a-train"])
    D.write_delimited(docs.where(test), paths["a-test"])
    D.write_delimited(docs.where(~test), paths["b-train"], sep="\t")
    D.write_delimited(docs.where(test).select("id", "tweet"), paths["b-text"], sep="\t")
    D.write_delimited(docs.where(test).select("id", "label"), paths["b-gold"], header=False)
    fi = X.fi(spark, sf).where(F.col("id").rlike("^[0-9]+$"))
    split = F.element_at(F.array(*[F.lit(x) for x in CS.GIVEN_SPLITS]), (F.col("id").cast("long") % 3).cast("int") + 1)
    (fi.select(F.col("id").alias("ID"), F.concat(F.lit("RT tweet "), F.col("id")).alias("Tweet"), F.col("dimension").alias("Affect Dimension"),
               F.col("intensity").alias("Intensity Class"), F.concat(F.lit("EI-oc-En-"), F.col("dimension"), F.lit("-"), split).alias("stem"))
       .write.partitionBy("stem").option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(paths["ei"]))
    files = {}
    for n, name in enumerate(("train", "val", "test")):
        part = docs.where(F.col("id") % 3 == n).withColumn("line", F.regexp_replace("tweet", "[\r\n]", " ")).withColumn("two", F.col("id") % 2)
        files[name] = (fresh_dir(spark, f"sources-text-{name}"), fresh_dir(spark, f"sources-label-{name}"))
        LN.write_lines(part, files[name][0], "id", "line")
        LN.write_lines(part, files[name][1], "id", "two")
    return CS.build_from_sources([CS.load_headed(spark, paths["a-train"], paths["a-test"], "sarcasm"),
                                  CS.load_by_id(spark, paths["b-train"], paths["b-text"], paths["b-gold"], "offensive"),
                                  CS.load_emotions(spark, paths["ei"]), CS.load_lines(spark, files, "hate")])
