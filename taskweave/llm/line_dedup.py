"""Line dedup by winnowing over line hashes: later copies of runs of lines are deleted.

The texts' lines (white space normalised, lines without words left out) are seen through windows: the shortest runs of lines
with at least ``min_words`` words that begin at a line, and those that end at a line.  Every repeated run with so many
words is the union of such windows, wherever it stands and whatever stands around it.

1. Winnowing: each window selects its line with the least hash (the first of equals).  Neighbouring windows mostly select the
   same line, so few lines are selected, and equal windows select the same line: a repeated run shares a selected line.
2. Positions are joined by the hashes of the selected lines, the fingerprints.  One that occurs once leaves here, with all
   its windows.  A fingerprint carries its neighbourhood, the hashes of the windows that selected it: a frequent short line
   has as many neighbourhoods, and matching all its positions with each other would square it.
3. Matches are extended both ways, by a window at a time: of the windows around a fingerprint that met, equal ones are
   matched with their first position, and those that follow each other make up the run, up to where the texts differ.
4. All positions of a run but the first are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_name, stored

MIN_WORDS = 50
SELECTED = "doc_id long, text_key long, fingerprint long, around array<struct<window: binary, first: int, last: int>>"
AROUND = pa.list_(pa.struct([("window", pa.binary()), ("first", pa.int32()), ("last", pa.int32())]))
SOURCE = "array<long>"


def lines_of(text: str) -> tuple[list[int], list[int], list[int], list[bytes], list[int]]:
    """Number, number of the last blank line behind it, words, digest and hash of each line that has words."""
    numbers, words, digests, hashes = [], [], [], []
    lines = text.encode().split(b"\n")
    for i, line in enumerate(lines):
        found = line.split()
        if found:
            digest = xxhash.xxh3_128_digest(b" ".join(found))
            numbers.append(i)
            words.append(len(found))
            digests.append(digest)
            hashes.append(int.from_bytes(digest[:8], "little", signed=True))
    return numbers, [*(i - 1 for i in numbers[1:]), len(lines) - 1], words, digests, hashes


def windows_of(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of at least ``min_words`` words that begin, or end, at a line; each once."""
    ends = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    forward = np.searchsorted(ends, ends[:-1] + min_words)           # the run i .. forward[i] - 1
    backward = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1  # the run backward[j] .. j
    found = {(i, int(e) - 1) for i, e in enumerate(forward) if e <= n}
    found.update((int(s), j) for j, s in enumerate(backward) if s >= 0)
    return sorted(found)


def selected(words: list[int], hashes: list[int], min_words: int) -> dict[int, list[tuple[int, int]]]:
    """The selected lines of a text (the first with the least hash of any window), each with the windows that select it."""
    found: dict[int, list[tuple[int, int]]] = {}
    for first, last in windows_of(words, min_words):
        found.setdefault(min(range(first, last + 1), key=hashes.__getitem__), []).append((first, last))
    return found


def winnowed(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, text_key, text`` -> the selected lines of all texts: their hash and the windows around them."""
    def rows(it):
        types = (pa.int64(), pa.int64(), pa.int64(), AROUND)
        names = ["doc_id", "text_key", "fingerprint", "around"]
        for b in it:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                out = []
                for i, k, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist()):
                    numbers, stops, words, digests, hashes = lines_of(text or "")
                    for line, around in selected(words, hashes, min_words).items():
                        out.append((i, k, hashes[line], [
                            {"window": digests[a] if a == z else xxhash.xxh3_128_digest(b"".join(digests[a:z + 1])), "first": numbers[a], "last": stops[z]}
                            for a, z in around]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.mapInArrow(rows, SELECTED)


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_key, text`` -> ``doc_id, text_key, runs, sources`` for the texts with later copies.

    ``runs`` are (first, last) line numbers to delete, ``sources`` the ids of the documents where they stand first.
    Positions are ordered by doc_id (nulls last), text key and line.  Only windows whose fingerprint occurs
    more than once go on, and only those that occur more than once themselves are joined to their first position; counts and
    minima are pre-aggregated before the shuffle, and Spark splits a hot fingerprint or window in the joins.
    A copy that overlaps its first position in the same text loses only the lines behind it.
    """
    lines = stored(spark, winnowed(docs, min_words), "line-fingerprints")
    again = lines.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = lines.join(again, "fingerprint", "left_semi")
    found = stored(spark, met.select("doc_id", "text_key", F.inline("around")), "line-windows")
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "first", "last")
    heads = found.groupBy("window").agg(F.min(at).alias("head"), F.max(at).alias("end")).where("head != end").drop("end")
    later = (found.join(heads, "window").where(at != F.col("head"))
             .withColumn("same", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
             .withColumn("first", F.when(F.col("same"), F.greatest("first", F.col("head.last") + 1)).otherwise(F.col("first")))
             .where("first <= last"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"),
                                                   F.array_sort(F.collect_set("head.doc_id")).alias("sources"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents without the later copies of runs of lines; one row for each input row, all columns kept.

    A line goes if it lies in a run of consecutive lines with at least ``min_words`` words that stands earlier, in a
    document of smaller id or higher up in the same text; the first copy stays, so nothing is lost from the corpus.  Blank
    lines are no part of a run and go with the line before them.
    Texts without such a line are unchanged.  Two columns are added: ``removed_lines`` (int) and ``copied_from`` (ids of
    the documents that keep the lines).

    Nulls: a null text stays null; a null doc_id comes last in the order.  Empty and wordless texts have no lines to lose;
    a text of which all lines go is empty.  Rows with equal doc_id and text are one document and are treated alike.  An
    empty table gives an empty result.
    """
    key, known, runs, sources, lines = (new_name(docs, x) for x in ("__text_key", "__known", "__runs", "__sources", "__lines"))
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    gone = repeated_runs(spark, narrow, min_words).select(F.col("doc_id").alias(known), F.col("text_key").alias(key),
                                                         F.col("runs").alias(runs), F.col("sources").alias(sources))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(known)) & (F.xxhash64(text) == F.col(key)), "left")
    stays = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists(F.col(runs), lambda r: (r["first"] <= i) & (i <= r["last"])))
    out = joined.withColumn(lines, F.when(F.col(runs).isNotNull(), stays))
    kept = F.when(F.col(runs).isNull(), text).otherwise(F.array_join(F.col(lines), "\n"))
    removed = F.when(F.col(runs).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)) - F.size(lines)).cast("int")
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, removed.alias(new_name(docs, "removed_lines")),
                      F.coalesce(F.col(sources), F.array().cast(SOURCE)).alias(new_name(docs, "copied_from")))
