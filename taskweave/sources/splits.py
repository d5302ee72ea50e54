"""Text files read in many splits whose reading state depends on what stands before.

Spark reads the pieces of a file (lines, or what stands between other separators) in order inside a file split.  A format
whose pieces mean different things in different states (inside a quoted text, inside an array) is read in two passes:

1. every split is scanned without knowing its state and tells what it does to it (``summarise``): a small row;
2. these rows, one for each file split, are combined in file order (``combine``) into the state at the beginning of each
   split, and every split is read from the state that is right for it (``read``).

No piece moves between tasks.  The states are one small entry for each file split, as many as the scan has tasks to
schedule; they go through the driver, as the list of the splits itself does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow types of the columns that ``read`` may yield.
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
#: Rows that are handed on together.
ROWS = 8192


def pieces(spark: SparkSession, paths: str | Sequence[str], separator: str, recursive: bool = False) -> DataFrame:
    """``piece, path, start`` (of the file split) of the files; pieces are in order inside a split."""
    found = spark.read.option("lineSep", separator).option("recursiveFileLookup", recursive).text(paths if isinstance(paths, str) else list(paths))
    return found.select(F.col("value").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, start, pieces) of each split of a task, one after the other."""
    def rows():
        for b in batches:
            yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist())

    it = rows()
    row = next(it, None)
    while row is not None:
        path, start = row[:2]

        def own():
            nonlocal row
            while row is not None and row[:2] == (path, start):
                yield row[2]
                row = next(it, None)

        mine = own()
        yield path, start, mine
        for _ in mine:  # whatever has not been read
            pass


def read_splits(found: DataFrame, summarise: Callable[[Iterator[str]], Any], combine: Callable[[Any, Any], Any], first: Any,
                read: Callable[[str, int, Iterator[str], Any], Iterator[tuple]], schema: str, one_text: bool = False) -> DataFrame:
    """Rows (``schema``) that ``read(path, start, pieces, state)`` yields for each split.

    ``summarise(pieces)`` describes a split, ``combine(state, summary)`` is the state behind it; a file begins in ``first``,
    or, if the files in order of their names are ``one_text``, in the state behind the one before.
    """
    def summaries(batches):
        for path, start, own in _by_split(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([cloudpickle.dumps(summarise(own))], pa.binary())],
                                             ["path", "start", "summary"])

    states: dict[tuple[str, int], Any] = {}
    at, state = None, first
    for r in found.mapInArrow(summaries, "path string, start long, summary binary").orderBy("path", "start").toLocalIterator():
        if r["path"] != at and not (one_text and at):
            state = first
        at = r["path"]
        if state != first:
            states[r["path"], r["start"]] = state
        state = combine(state, cloudpickle.loads(r["summary"]))
    shared = found.sparkSession.sparkContext.broadcast(states)
    fields = [c.split() for c in schema.split(", ")]

    def rows(batches):
        out: list[tuple] = []

        def flush():
            columns = [pa.array(c, ARROW[t]) for c, (_, t) in zip(zip(*out), fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

        for path, start, own in _by_split(batches):
            for row in read(path, start, own, shared.value.get((path, start), first)):
                out.append(row)
                if len(out) >= ROWS:
                    yield flush()
        if out:
            yield flush()

    return found.mapInArrow(rows, schema)
