"""Delimited-file sources (S1, S2, S5) with explicit schemas.

The reference reads with pandas, which turns a fixed list of strings into
missing values.  Spark's ``nullValue`` takes one token, so the list is applied
as an expression after the read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .records import read_records

# Strings pandas' read_csv reads as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def null_na_tokens(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NA tokens by NULL in the string columns (all of them by default)."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(c)) for c in names})


def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, header: bool = True,
                   sep: str = ",", mode: str = "as_written", na_tokens: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV or TSV with double-quote quoting.

    ``mode="as_written"`` keeps quote processing for TSV as the reference does (an
    unbalanced quote swallows following rows); ``"intended"`` turns quoting off for
    TSV.  Files are split over many tasks, also with ``multi_line``, which is for texts with
    quoted line breaks (see ``records``).
    """
    quote = '"' if (sep != "\t" or mode == "as_written") else "\u0000"
    if multi_line and quote == '"':
        df = parsed(read_records(spark, paths, sep), schema, sep, header).select("row.*")
        return null_na_tokens(df) if na_tokens else df
    df = (spark.read.schema(schema)
          .option("header", header).option("sep", sep).option("quote", quote).option("escape", '"')
          .option("mode", "PERMISSIVE")
          .csv(list(paths) if not isinstance(paths, str) else paths))
    return null_na_tokens(df) if na_tokens else df


def parsed(records: DataFrame, schema: StructType | str, sep: str, header: bool) -> DataFrame:
    """``path, row`` (struct of ``schema``) of the records, without each file's first one if it is a header."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    rows = records.where(~F.col("leads")) if header else records
    return rows.select("path", F.from_csv("record", ddl, options).alias("row"))


def write_delimited(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Write ``df`` as quoted delimited text (one part file per partition)."""
    (df.write.mode("overwrite").option("header", header).option("sep", sep)
       .option("quote", '"').option("escape", '"').csv(path))


def read_with_provenance(spark: SparkSession, base: str, schema: StructType | str, pattern: str,
                         groups: Sequence[str], sep: str = "\t", header: bool = True, multi_line: bool = False) -> DataFrame:
    """One logical table from many files; provenance columns parsed from each file's path.

    ``pattern`` is a regex over the file path whose capture groups map to ``groups``.
    """
    if multi_line:
        df = parsed(read_records(spark, base, sep, recursive=True), schema, sep, header).select("row.*", "path")
        path = F.col("path")
    else:
        df = (spark.read.schema(schema).option("header", header).option("sep", sep)
              .option("quote", '"').option("escape", '"').option("recursiveFileLookup", True).csv(base))
        path = F.col("_metadata.file_path")
    df = df.withColumns({g: F.regexp_extract(path, pattern, i + 1) for i, g in enumerate(groups)}).drop("path")
    return null_na_tokens(df, [f.name for f in df.schema.fields
                               if isinstance(f.dataType, StringType) and f.name not in groups])
