"""Corpus pipeline over ``documents``: STAGES in order, each applied to all that its predecessor kept.

Every stage's result is written as Parquet into the shared folder and read again as the next one's documents.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from taskweave.llm import byte_bpe, line_dedup, mixing, quality, simhash_dedup
from taskweave.llm.common import read_table, stored

#: No SQL: the distance rules, window hashes, fingerprints and merges are tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.drop_rejected(spark, docs)


def dedup_lines(spark, docs, sf_dir):
    """All documents without later copies of runs of lines; ``n_chars``, if there, follows the text."""
    out = line_dedup.dedup_lines(spark, docs)
    removed = out.columns[len(docs.columns)]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each SimHash component."""
    return simhash_dedup.drop_near_duplicates(spark, docs, words_each=4, most=4)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the target weights of its source say."""
    return mixing.mix(docs)


def encode_bytes(spark, docs, sf_dir):
    """Digests of every document's ids and of the text decoded from them."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_digest(spark, docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_near_dedup", simhash_near_dedup),
          ("source_mixing", mix_sources), ("byte_bpe", encode_bytes)]


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
