"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, read_table

__all__ = ["SPACE", "WORD", "fresh_dir", "read_table", "stored", "new_name", "n_words", "bounded_sample"]

#: The white space between words, and a word, as a regular expression (Java, Python and DuckDB alike).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder of the shared checkpoint folder and read it back.

    This cuts the lineage: what follows survives the loss of executors without running the past again.
    """
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text):
    """Number of words of a text column; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, n_rows: int, n: int, *columns: str) -> DataFrame:
    """The up to ``n`` rows of ``df`` (of ``n_rows``) with the smallest hash of ``columns``.

    Rows are first thinned to about 2 n by a bound on the hash, so tasks don't each hand on n rows to be merged.
    """
    key = F.xxhash64(*columns)
    if n_rows > 2 * n:
        df = df.where(key < F.lit(int((2 * n / n_rows - 0.5) * 2.0 ** 64)).cast("long"))
    return df.orderBy(key, *columns).limit(n)
