"""Streaming corpus preparation.

The reference has no streaming.  Its row-wise work -- label normalisation and
text cleaning (2.B, 2.C) -- uses no actions, so the same expressions run on a
Structured Streaming DataFrame: newly arriving documents are joined to the
(static) label table, unpivoted into one row per task, normalised and cleaned,
then appended to a parquet table partitioned by task.  Stream-static inner
joins need no state or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import labels as L
from ..functions import text as T
from ..plans.fixtures import FD_TASKS
from ..session import read_table, shared_dir, table_path

DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def corpus_stream(spark: SparkSession, sf_dir: str, mode: str = T.AS_WRITTEN,
                  max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming canonical rows ``row_id, tweet, emotion, emotion_ind, task``."""
    docs = (spark.readStream.schema(DOCUMENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(table_path(sf_dir, "documents").rsplit("/", 1)[0] + "/documents*.parquet")
            .select("doc_id", "text"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    long = docs.join(labels, "doc_id").unpivot(["doc_id", "text"], list(FD_TASKS), "task", "label")
    ind = L.binary_label(F.col("label"), numeric=True)
    return long.select(
        F.concat(F.col("task"), F.lit(":"), F.col("doc_id").cast("string")).alias("row_id"),
        T.sanitize(T.decorate("text", "doc_id"), mode).alias("tweet"),
        L.class_name(ind, F.col("task")).alias("emotion"),
        ind.alias("emotion_ind"),
        "task")


def start_corpus_sink(stream: DataFrame, out_path: str, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Append the cleaned rows to parquet partitioned by task (exactly-once via the checkpoint)."""
    spark = stream.sparkSession
    ckpt = checkpoint or shared_dir(spark, "stream-checkpoints", out_path.rstrip("/").rsplit("/", 1)[-1])
    w = (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
         .partitionBy("task").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
