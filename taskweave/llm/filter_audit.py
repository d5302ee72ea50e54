"""Filter interaction audit: what each filter removes, for every order in which a set of filters can be applied.

A document has a mask of the filters that it fails.  In an order, it is removed by the failed filter that comes first, so
its removal step is the min-plus product of its mask row (0 where it fails, infinite where it passes) and the matrix of
positions (the inverse permutation of each order): step(mask, order) = min over filters of cost(mask, filter) +
position(filter, order).  Documents of one mask share their steps, so the masks are counted by part before anything else
(map-side, then one narrow shuffle), and the counts, as weights, are scattered to (order, step).
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Filters that look at the text alone, in order; the last one of ``NAMES`` is the copy of an earlier document.
NAMES = "ABCDE"
COPY = len(NAMES) - 1
MASKED = "doc_id long, part string, digest binary, mask int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
CAPITALS, FOLLOWING, SIGNS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails: under 100 words, under 80 % distinct words, over 10 %
    capitals A-Z among its code points, one of the signs."""
    words = text.split()  # ASCII white space only
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    inner = 0 if text.isascii() else len(text) - len(text.translate(None, FOLLOWING))  # bytes that begin no code point
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * (len(text) - inner)) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def min_plus(costs: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product of (masks x filters) and (filters x orders), one filter at a time."""
    out = np.full((len(costs), positions.shape[1]), np.inf)
    for f in range(costs.shape[1]):
        np.minimum(out, costs[:, f, None] + positions[f], out=out)
    return out


class Orders:
    """All orders of some filters and the removal step of each mask in each order (steps from 0, infinite: never)."""

    def __init__(self, names: str):
        self.size = len(names)
        orders = list(permutations(range(self.size)))
        self.labels = ["".join(names[f] for f in o) for o in orders]
        self.filters = np.array(orders)
        self.positions = np.argsort(self.filters, axis=1).T
        masks = np.arange(1 << self.size)
        self.fails = (masks[:, None] >> np.arange(self.size) & 1).astype(bool)
        self.steps = min_plus(np.where(self.fails, 0.0, np.inf), self.positions)

    def audit(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """``weights``: (masks x 3) counts of documents, good ones and toxic ones -> (orders x steps) arrays."""
        n_orders = len(self.labels)
        mask, order = np.nonzero(np.isfinite(self.steps))
        step = self.steps[mask, order].astype(np.int64)
        lost = np.zeros((3, n_orders, self.size), np.int64)
        for k in range(3):
            np.add.at(lost[k], (order, step), weights[mask, k])
        by_filter = np.zeros(self.size, np.int64)
        np.add.at(by_filter, self.filters, lost[0])
        failing = self.fails.T.astype(np.int64) @ weights[:, 0]
        alone = weights[1 << np.arange(self.size), 0]
        return {"kept": weights[:, 0].sum() - np.cumsum(lost[0], axis=1), "removed": lost[0], "redundant": failing[self.filters] - lost[0],
                "unique_fails": alone[self.filters], "good_lost": lost[1], "toxic_lost": lost[2], "shapley": by_filter[self.filters]}


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``doc_id, part, digest, mask`` (filters of the text alone) of every whole text."""
    def rows(it):
        for b in it:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                texts = [(t or "").encode() for t in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    s.column(0), s.column(1), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array([text_mask(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "mask"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(rows, MASKED)


def mask_counts(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and mask of all five filters.

    A copy fails the last filter if any smaller id has its text, so of the rows of a text those with its least id pass.
    Rows are first counted by text and id, so a text that stands in a third of all documents is no hot key: then each
    group of text, part and flags keeps its sum and the count at its least id, and only these few rows meet by text.
    """
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good, toxic)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    own = masked(docs, id_col, text_col, part_col).groupBy("digest", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(known, "doc_id", "left").select("digest", "mask", "part", "n", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id").alias("at"), *flags)
    groups = stored(spark, own.groupBy("digest", "mask", "part", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min("at").alias("at"), F.min_by("n", "at").alias("n_first")), "filter-groups")
    least = groups.groupBy("digest").agg(F.min("at").alias("least"))
    marked = groups.join(least, "digest").withColumn("first", F.when(F.col("at") == F.col("least"), F.col("n_first")).otherwise(F.lit(0)))
    split = marked.select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("m"))
    return split.where("m.n > 0").groupBy("part", "m.mask").agg(
        F.sum("m.n").alias("n"), F.sum(F.when(F.col("quality"), F.col("m.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic"))


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step (columns of ``AUDIT``), zeros included.

    The filters are A to D (``text_mask``) and E: the text is that of a document with a smaller id, in whatever part and
    removed or not.  ``kept`` counts the part's documents after this step, ``removed`` those that go here, ``redundant`` those that fail
    the step's filter but went earlier, ``unique_fails`` those that fail no other filter, ``good_lost`` and ``toxic_lost``
    those removed here with a label of quality 1 or toxic 1, ``shapley`` what the filter removes over all orders.

    Nulls: a null text is empty, a null part the empty string; a null id comes last in the order, so it fails E if any
    known id has its text, and has no label.  Rows of one id are documents each; they are no copies of each other.  A document
    has a flag if any of its label rows has it.  Empty texts fail A only, or E.  An empty table gives an empty result.  Other
    columns are not read, so their names don't matter.
    """
    counts = mask_counts(spark, docs, labels, id_col, text_col, part_col)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # at most 32 a part
    names = NAMES

    def audited(it):
        orders = Orders(names)
        steps = len(orders.labels) * orders.size
        of_row = np.repeat(orders.labels, orders.size)
        numbers = np.tile(np.arange(1, orders.size + 1, dtype=np.int32), len(orders.labels))
        for b in it:
            for part, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                weights = np.zeros((1 << orders.size, 3), np.int64)
                for r in rows:
                    weights[r["mask"]] = r["n"], r["good"], r["toxic"]
                found = orders.audit(weights)
                yield pa.RecordBatch.from_arrays([pa.array([part] * steps), pa.array(of_row), pa.array(numbers), *[pa.array(found[c].reshape(-1)) for c in COUNTS]],
                                                 ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(audited, AUDIT)
