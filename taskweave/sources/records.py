"""Records of delimited files with quoted line breaks, read in many splits.

Whether a line break ends a record depends on the quotes before it.  A line is a small automaton: begun outside or inside
a quoted text, it ends outside or inside.  A split's lines together are one such automaton of two states (its summary);
the summaries of a file, combined in order, give the state in which each split begins.  Records inside a split are put
together there; those that cross splits are joined from one or two fragments of each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_dir
from .splits import pieces, read_splits

#: A whole record, the end of a record that began in an earlier split, the beginning of one that goes on in a later split.
WHOLE, HEAD, TAIL = 0, 1, 2
RECORDS = "path string, start long, kind int, leads boolean, record string"


class Lines:
    """Whether a text with quotes ends inside a quoted field.

    A quote opens a field only at its beginning, two quotes inside stand for one, and what follows a closing quote belongs
    to the field up to the separator.
    """

    def __init__(self, sep: str, quote: str = '"'):
        s, q = re.escape(sep), re.escape(quote)
        body = rf"(?:[^{q}]++|{q}{q})*+"
        field = rf"(?:{q}{body}{q}[^{s}]*+|(?!{q})[^{s}]*+)"
        opened = rf"(?:{field}{s})*+{q}{body}\Z"
        self.quote = quote
        self.from_outside = re.compile(opened).match
        self.from_inside = re.compile(rf"{body}(?:\Z|{q}[^{s}]*+{s}{opened})").match

    def inside(self, line: str, inside: bool) -> bool:
        """The state behind a line that begins ``inside`` (or outside) a quoted text."""
        if self.quote not in line:
            return inside
        return bool((self.from_inside if inside else self.from_outside)(line))


def _records(lines: Lines, own: Iterator[str], inside: bool, begun: bool) -> Iterator[tuple[int, bool, str]]:
    """(kind, whether it is the file's first record, text) of a split's records and fragments; empty lines are no records."""
    kind, parts = (HEAD if inside else WHOLE), []
    for line in own:
        if not inside and not parts and line in ("", "\r"):
            continue
        parts.append(line)
        inside = lines.inside(line, inside)
        if not inside:
            text = "\n".join(parts)
            yield kind, not begun, text[:-1] if text.endswith("\r") else text
            kind, parts, begun = WHOLE, [], True
    if parts:
        yield (HEAD if kind == HEAD else TAIL), not begun, "\n".join(parts)


def read_records(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", quote: str = '"', recursive: bool = False) -> DataFrame:
    """``path, leads, record``: the text of every record of the files; ``leads`` marks the first record of a file.

    Line breaks are ``\\n`` or ``\\r\\n``.  A quoted text that isn't closed goes on to the end of its file.  The records are
    stored once in the shared folder: whole and crossing ones, and every later pass, would each read the files again.
    """
    lines = Lines(sep, quote)

    def read(path, start, own, state):
        for kind, leads, text in _records(lines, own, *state):
            yield path, start, kind, leads, text

    def summarise(own):
        ends, filled = (False, True), False  # inside or not behind the split, if it begins outside, inside; any line not empty
        for line in own:
            filled = filled or line not in ("", "\r")
            if quote in line:
                ends = tuple(lines.inside(line, e) for e in ends)
        return ends, filled

    def combine(state, summary):
        (inside, begun), (ends, filled) = state, summary
        return ends[inside], begun or filled

    path = fresh_dir(spark, "records")
    read_splits(pieces(spark, paths, "\n", recursive), summarise, combine, (False, False), read, RECORDS).write.parquet(path)
    found = spark.read.schema(RECORDS).parquet(path)
    # a record that crosses splits begins with a TAIL, all up to the next TAIL of the file belongs to it
    parts = found.where(F.col("kind") != WHOLE)
    chain = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    crossing = (parts.withColumn("chain", chain).groupBy("path", "chain")
                .agg(F.max("leads").alias("leads"), F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
                .select("path", "leads", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    return found.where(F.col("kind") == WHOLE).select("path", "leads", "record").unionByName(crossing)
