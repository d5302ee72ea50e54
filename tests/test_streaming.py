"""Streaming smoke test: the streamed corpus equals the batch corpus rows."""

from pyspark.sql import functions as F

from table_paths import SF_SMALL
from taskweave.functions import text as T
from taskweave.plans import fixtures as X
from taskweave.session import fresh_dir
from taskweave.streaming.corpus_stream import corpus_stream, start_corpus_sink


def test_stream_matches_batch(spark):
    out = fresh_dir(spark, "stream-out")
    q = start_corpus_sink(corpus_stream(spark, SF_SMALL), out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = X.fd_raw(spark, SF_SMALL).select("row_id", T.sanitize("tweet").alias("tweet"), "emotion",
                                             "emotion_ind", "task")
    cols = ["row_id", "tweet", "emotion", "emotion_ind", "task"]
    assert got.count() == batch.count()
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert got.where(F.col("tweet").contains("@usr_")).count() == 0
