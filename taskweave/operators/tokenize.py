"""Fixed-length encoding with a vocabulary built from the corpus.

The reference feeds each tweet to a pretrained tokenizer one row at a time.  Here
the vocabulary is a corpus-scale aggregate and encoding is a join:

* tokens: the text split on Unicode whitespace (whole texts, every token counted);
* vocabulary: token counts, ids by descending count then token -- an exact global
  rank over a range shuffle (``range_rank``), so no task gets more than its range,
  however many tokens share a count or a prefix;
* encoding: the first ``max_len - 2`` tokens of each text, one row each with its
  position, meet the ``HEAD_TOKENS`` most frequent tokens (a proven bound) by broadcast;
  only the rare rest is shuffled by token.  So a token that stands in half of all texts
  never travels by its own key.  The ids are collected per text before the shuffle, put
  in order there, wrapped in start/end ids, padded with 0 and given a mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS
from ..session import fresh_dir
from .ranking import range_rank

# Special token ids.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
FIRST_ID = 4
#: So many of the most frequent tokens are broadcast (a few MB); rarer tokens can't be hot keys.
HEAD_TOKENS = 20_000
#: A position and an id travel in one long: the id in the low bits.
ID_BITS = 40


def tokens(text) -> "F.Column":
    """Whitespace tokens of a text (empty strings dropped)."""
    return F.array_remove(F.split(text, WS + "+"), "")


def tokenize_text(rows: DataFrame, text: str = "tweet", key: str = "row_id", materialize: bool = True) -> DataFrame:
    """``key, tokens`` for every row.

    The vocabulary and the encoding both consume the tokens; with ``materialize``
    the table is written once as parquet into the shared checkpoint folder (one
    pass; ``Dataset.checkpoint`` would compute the plan twice) so the cleaning
    upstream runs a single time and lineage is cut.
    """
    tok = rows.select(key, tokens(F.col(text)).alias("tokens"))
    if materialize:
        spark = rows.sparkSession
        path = fresh_dir(spark, "tokens")
        tok.write.mode("overwrite").parquet(path)
        tok = spark.read.parquet(path)
    return tok


def build_vocab(tok: DataFrame) -> DataFrame:
    """``token, count, id`` over every token of every text (``tok`` from ``tokenize_text``).

    A plain ``explode`` makes Spark filter by ``size(tokens) > 0`` first, which would clean and split every text again for it.
    """
    counts = (tok.select(F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    ranked = range_rank(counts, [F.col("count").desc(), F.col("token")], "rk")
    return ranked.select("token", "count", (F.col("rk") - 1 + FIRST_ID).alias("id"))


def encode_fixed(tok: DataFrame, vocab: DataFrame, max_len: int = 180, key: str = "row_id") -> DataFrame:
    """Adds ``n_tokens`` (whole text), ``input_ids`` and ``attention_mask`` (both ``max_len``)."""
    keep = max_len - 2
    sized = tok.select(key, F.size("tokens").alias("n_tokens"), F.slice("tokens", 1, keep).alias("__t"))
    # posexplode_outer keeps token-less rows (token NULL), so no join back is needed
    rows = sized.select(key, "n_tokens", F.posexplode_outer("__t").alias("__pos", "__token"))
    head = vocab.where(F.col("id") < FIRST_ID + HEAD_TOKENS).select(F.col("token").alias("__token"), F.col("id").alias("__id"))
    tail = vocab.where(F.col("id") >= FIRST_ID + HEAD_TOKENS).select(F.col("token").alias("__token"), F.col("id").alias("__rare"))
    known = rows.join(F.broadcast(head), "__token", "left")
    rare = F.col("__id").isNull() & F.col("__token").isNotNull()
    rest = known.where(rare).drop("__id").join(tail, "__token", "left").withColumn("__id", F.coalesce("__rare", F.lit(UNK).cast("long")))
    columns = [key, "n_tokens", "__pos", "__id"]
    both = known.where(~rare).select(*columns).unionByName(rest.select(*columns))
    place = F.shiftleft(F.col("__pos").cast("long"), ID_BITS).bitwiseOR(F.col("__id"))     # NULL without a token
    ids = both.groupBy(key, "n_tokens").agg(F.sort_array(F.collect_list(place)).alias("__s"))
    out = ids.withColumn("__b", F.transform("__s", lambda s: s.bitwiseAND(F.lit((1 << ID_BITS) - 1))))
    pad = F.array_repeat(F.lit(PAD).cast("long"), F.lit(keep) - F.size("__b"))
    return out.select(
        key, "n_tokens",
        F.concat(F.array(F.lit(BOS).cast("long")), F.col("__b"), F.array(F.lit(EOS).cast("long")), pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("__b") + 2), F.array_repeat(F.lit(0), F.lit(keep) - F.size("__b")))
        .alias("attention_mask"))
