"""Registered queries for corpus-level text encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import tokenize as TK
from .functions import text as T
from .plans import fixtures as X

MAX_LEN = 180


def _texts(spark, sf):
    return X.ft(spark, sf).select("row_id", T.sanitize("tweet").alias("tweet"))


@query("txt_vocab")
def q_txt_vocab(spark, sf):
    return TK.build_vocab(TK.tokenize_text(_texts(spark, sf), materialize=False))


@query("txt_encode_fixed")
def q_txt_encode_fixed(spark, sf):
    tok = TK.tokenize_text(_texts(spark, sf))
    enc = TK.encode_fixed(tok, TK.build_vocab(tok), max_len=MAX_LEN)
    ids = F.concat_ws(",", F.transform("input_ids", lambda x: x.cast("string")))
    return enc.select("row_id", "n_tokens", F.md5(ids).alias("ids_md5"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
                      F.size("input_ids").alias("length"))
