"""Nested similarity series in JSON, ``{"pair": {"group": [value, ...], ...}, ...}``, written and read in pieces.

The text is cut at commas, so an array of any length is many pieces, and one object (or one line) of any size is many
splits.  A piece holds at most the names before a value and the value; a name with a comma in it is several pieces.  What a
split does not know about itself is the pair, the group and the place in the array it begins with, and whether it begins
inside a name; ``splits`` brings that from the splits before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import pieces, read_splits

TOKENS = "pair string, grp string, idx long, token string"
PAIR, GROUP, VALUE = range(3)
#: A name has so many characters at most (a split of numbers that is taken for part of a name is told by this).
NAME_MOST = 1 << 16
QUOTES = re.compile(r'\\.|"').findall
NAME = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match
STRUCTURE = re.compile(r"[\s{}\]]*").match
OPENS = re.compile(r"\s*:\s*([{\[])").match
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s\]}]+', re.S).match


def ends_in_name(piece: str, inside: bool) -> bool:
    """Whether a text that begins inside a name (or not) ends inside one."""
    return inside ^ bool(QUOTES(piece).count('"') & 1 if '"' in piece else 0)


def events(piece: str) -> Iterator[tuple[int, str]]:
    """What a piece with whole names holds: a pair, a group, a value's text."""
    at = STRUCTURE(piece).end()
    while at < len(piece):
        name = NAME(piece, at)
        opens = OPENS(piece, name.end()) if name else None
        if opens:
            yield (PAIR if opens[1] == "{" else GROUP), json.loads(name[0])
            at = opens.end()
        else:
            token = TOKEN(piece, at)
            yield VALUE, token[0]
            at = token.end()
        at = STRUCTURE(piece, at).end()


class Reader:
    """``pair, grp, idx`` of the next value, and the beginning of a name that isn't whole yet."""

    def __init__(self, pair=None, grp=None, idx=0, begun=None):
        self.pair, self.grp, self.idx, self.begun = pair, grp, idx, begun

    def take(self, piece: str) -> Iterator[tuple[str, str, int, str]]:
        if self.begun is not None:
            piece = f"{self.begun},{piece}"
        self.begun = piece if ends_in_name(piece, False) else None
        if self.begun is None:
            for kind, text in events(piece):
                if kind == PAIR:
                    self.pair, self.grp = text, None
                elif kind == GROUP:
                    self.grp, self.idx = text, 0
                else:
                    yield self.pair, self.grp, self.idx, text
                    self.idx += 1

    def state(self) -> tuple:
        return self.pair, self.grp, self.idx, self.begun


class Effect:
    """What pieces that begin outside names do: (pair, group, values since the group or the beginning, begun name)."""

    def __init__(self):
        self.reader, self.n = Reader(), 0

    def take(self, piece: str) -> None:
        for _ in self.reader.take(piece):
            self.n += 1

    def result(self) -> tuple:
        pair, grp, idx, begun = self.reader.state()
        return pair, grp, (self.n if grp is None else idx), begun


def _after(state: tuple, effect: tuple) -> tuple:
    (pair, grp, idx, _), (new_pair, new_grp, n, begun) = state, effect
    if new_grp is None:
        return (pair, grp, idx + n, begun) if new_pair is None else (new_pair, None, 0, begun)
    return new_pair if new_pair is not None else pair, new_grp, n, begun


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``pair, grp, idx, token``: the text of every value, for one object in one file, in a folder of files in order
    (as ``write`` leaves them), or an object on each line."""
    def summarise(own):
        """The effect if the split begins outside names; and if inside: the text up to the name's end, and the effect of the rest."""
        outside, head, size, rest = Effect(), [], 0, None
        for piece in own:
            outside.take(piece)
            if rest is not None:
                rest.take(piece)
            elif size <= NAME_MOST:
                head.append(piece)
                size += len(piece)
                if not ends_in_name(piece, True):
                    rest = Effect()
        return outside.result(), ",".join(head) if size <= NAME_MOST else None, rest.result() if rest else None

    def combine(state, summary):
        outside, head, rest = summary
        if state[3] is None:
            return _after(state, outside)
        if head is None:
            raise ValueError(f"a name is longer than {NAME_MOST} characters")
        reader = Reader(*state)
        for _ in reader.take(head):
            pass
        return reader.state() if rest is None else _after(reader.state(), rest)

    def read(_path, _start, own, state):
        reader = Reader(*state)
        for piece in own:
            yield from reader.take(piece)

    return read_splits(pieces(spark, path, ","), summarise, combine, Reader().state(), read, TOKENS, one_text=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``pair, grp, idx, similarity``; NaN and infinities are bare tokens, null is NULL."""
    return read_tokens(spark, path).select("pair", "grp", "idx", F.when(F.col("token") != "null", F.col("token").cast("double")).alias("similarity"))


def _number(v) -> Column:
    """A number as JSON text; NaN and infinities are bare tokens, as the reference writes them (to_json quotes them)."""
    return F.when(v.isNull(), F.lit("null")).otherwise(v.cast("string"))


def document(long: DataFrame, groups: tuple[str, ...], key: str, grp: str, idx: str, value: str) -> DataFrame:
    """``value`` lines, dealt by range and in order: together they are one JSON object.  Every pair has all ``groups``.

    A value is a line, and so is what stands before and behind an array, so no series is ever in one row.
    """
    place = F.lit(None)
    for i, g in enumerate(groups):
        place = F.when(F.col(grp) == g, i).otherwise(place)
    rows = long.withColumn("__ord", place.cast("int")).where("__ord IS NOT NULL").select(
        F.col(key).alias("__key"), "__ord", F.col(idx).alias("__at"), F.col(value).alias("__value"))
    first = rows.groupBy("__key", "__ord").agg(F.min("__at").alias("__first"))               # a row for each series
    comma = F.when(F.col("__at") == F.col("__first"), "").otherwise(",")
    values = rows.join(first, ["__key", "__ord"]).select("__key", "__ord", F.lit(1).alias("__kind"), "__at", F.concat(comma, _number(F.col("__value"))).alias("value"))
    pairs = rows.groupBy("__key").agg(F.lit(1).alias("__one"))
    ends = rows.agg(F.min("__key").alias("__least"), F.max("__key").alias("__last"), F.lit(1).alias("__one"))
    name = F.to_json(F.array(F.col("__key")))                     # ["name"], escaped
    opened = F.concat(F.when(F.col("__key") == F.col("__least"), "{").otherwise(","), F.substring(name, 2, F.length(name) - 2), F.lit(f':{{"{groups[0]}":['))
    closed = F.concat(F.lit("]}"), F.when(F.col("__key") == F.col("__last"), "}").otherwise(""))
    texts = [opened, *(F.lit(f'],"{g}":[') for g in groups[1:]), closed]
    marks = pairs.join(ends, "__one").select("__key", F.posexplode(F.array(*texts)).alias("__ord", "value")).select(
        "__key", "__ord", F.lit(0).alias("__kind"), F.lit(None).cast(long.schema[idx].dataType).alias("__at"), "value")
    order = ["__key", "__ord", "__kind", "__at"]
    return values.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order).select("value")
