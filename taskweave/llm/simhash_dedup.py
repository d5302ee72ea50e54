"""SimHash near-duplicates by pigeonring filtering.

64 bits are cut into ``most + 1`` segments in a ring.  If two fingerprints differ in at most ``most`` bits, there is a
segment from which every chain of l consecutive segments holds at most floor(l * most / segments) differences: 0 in the
first, 1 in the first two, and so on.  So candidates share the first segment of a chain and differ in at most one bit of
the second, in two of the second and third, and so on.  An equi-join on the first ``depth`` segments of a chain finds them
when one side lists all the ways to flip so few bits.  Unrelated fingerprints meet by chance, the more the shorter the key:
``depth`` grows with the number of fingerprints, so that few do.  Longer chains are tried before the full Hamming distance;
all of it is the join's condition, so only links leave the join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_name, stored
from .components import components
from .fingerprints import SEED, fingerprint

WORDS_EACH, MOST = 4, 4
#: Unrelated fingerprints that may share a key, on average, before keys get a segment longer.
STRANGERS = 4


def ring(most: int, bits: int = 64) -> list[tuple[int, int]]:
    """(start, width) of the most + 1 segments of a fingerprint."""
    cuts = [round(i * bits / (most + 1)) for i in range(most + 2)]
    return [(i, j - i) for i, j in zip(cuts, cuts[1:])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS_EACH, seed: int = SEED) -> DataFrame:
    """``doc_id, key, fp``: the 64-bit SimHash (as a signed long) of every whole text, and a hash that finds the text again;
    null and wordless texts have SimHash 0."""
    def rows(it):
        for b in it:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                fps = np.array([fingerprint(t, words_each, seed) for t in s.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(rows, "doc_id long, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(i: int, depth: int, most: int, segments: list[tuple[int, int]]) -> list[int]:
    """The masks by which the segments after the first of a chain of ``depth`` from segment ``i`` on may differ: of each first
    l of them at most floor(l * most / m) bits, the first segment none."""
    m = len(segments)
    out = [(0, 0)]  # mask, number of bits
    for l in range(2, depth + 1):
        start, width = segments[(i + l - 1) % m]
        bits = [1 << (start + b) for b in range(width)]
        out = [(mask | sum(some), n + k) for mask, n in out for k in range(l * most // m - n + 1) for some in combinations(bits, k)]
    return [mask for mask, _ in out]


def key_depth(n: int, most: int) -> int:
    """Segments of a key for ``n`` distinct fingerprints: so many that chance brings at most ``STRANGERS`` of them to a key."""
    segments = ring(most)
    for depth in range(min(2, len(segments)), len(segments)):
        if n <= STRANGERS << min(sum(w for _, w in (segments + segments)[i:i + depth]) for i in range(len(segments))):
            return depth
    return len(segments)


def links(fps: DataFrame, most: int = MOST, depth: int = 2) -> DataFrame:
    """Distinct fingerprints ``fp`` -> the pairs ``a < b`` that differ in 1 to ``most`` bits (most >= 1), each once.

    Every fingerprint gives one row for each chain on one side, and on the other one for each chain and way to flip bits in the
    ``depth`` segments of its key (70 rows of 26 bits for depth 2, 1,370 of 39 bits for depth 3, with 5 segments).
    Spark splits hot keys of this equi-join; copies are one fingerprint here.
    """
    segments = ring(most)
    m = len(segments)
    whole = (1 << 64) - 1

    def mask_of(i, l):
        mask = 0
        for j in range(i, i + l):
            start, width = segments[j % m]
            mask |= ((1 << width) - 1) << start & whole
        return mask

    def long(x):
        return F.lit(_signed(x & whole)).cast("long")

    # the key: the chain's first segments of the fingerprint, in place
    holders = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(long(mask_of(i, depth))).alias("key")) for i in range(m)])).alias("k")).select("b", "k.*")
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(long(mask_of(i, depth))).alias("own"),
                 F.array(*[long(f) for f in flips(i, depth, most, segments)]).alias("flips")) for i in range(m)])).alias("k"))
    probes = probes.select("a", "k.chain", "k.own", F.explode("k.flips").alias("flip")).select("a", "chain", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chains = F.lit(True)
    for l in range(3, m):
        masks = [long(mask_of(i, l)) for i in range(m)]
        chains = chains & (F.bit_count(differ.bitwiseAND(F.get(F.array(*masks), probes["chain"]))) <= l * most // m)
    # sizes are guessed from the few columns before the rows are listed, so without the hint a side might be broadcast
    return (probes.hint("merge").join(holders.hint("merge"), (probes["chain"] == holders["chain"]) & (probes["key"] == holders["key"]) & (F.col("a") < F.col("b"))
                        & chains & (F.bit_count(differ) <= most))
            .select("a", "b").distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, words_each: int = WORDS_EACH, most: int = MOST, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Documents are linked if their fingerprints differ in at most ``most`` bits; the component's id is the smallest doc_id
    reachable.  Copies collapse into one fingerprint before anything is joined.  Null and wordless texts have fingerprint
    0 and are linked like any other; a null doc_id is kept and never the smallest, so a component of such rows only has a
    null id.  Repeated rows and doc_ids each give a row.  An empty table gives an empty result.
    """
    own = stored(spark, fingerprints(docs, id_col, text_col, words_each, seed), "simhash-fingerprints")
    rooted = _rooted(spark, own, most)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(spark: SparkSession, own: DataFrame, most: int) -> DataFrame:
    """``fp, least, key, root`` for each distinct fingerprint: its least doc_id (null if it has no other), the key of that
    document's text, and its component's least fingerprint."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    nodes = stored(spark, own.groupBy("fp").agg(head.alias("head")).select("fp", F.col("head.doc_id").alias("least"), "head.key"), "simhash-nodes")
    dealt = nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # few files, many rows to list
    roots = components(spark, links(dealt, most, key_depth(nodes.count(), most))).withColumnRenamed("node", "fp")
    return stored(spark, nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, words_each: int = WORDS_EACH, most: int = MOST, seed: int = SEED,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest doc_id (nulls last), then fingerprint.

    Of rows that agree in both, any one stays.  Nulls, empty texts and empty tables as in ``near_duplicates``.
    """
    own = stored(spark, fingerprints(docs, id_col, text_col, words_each, seed), "simhash-fingerprints")
    first = F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "fp", "key"))
    kept = _rooted(spark, own, most).groupBy("root").agg(first.alias("first"))
    id_mark, key_mark, key = new_name(docs, "__kept_id"), new_name(docs, "__kept_key"), new_name(docs, "__key")
    kept = kept.select(F.col("first.least").alias(id_mark), F.col("first.key").alias(key_mark))
    marked = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    alive = marked.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(id_mark)) & (F.col(key) == F.col(key_mark)), "left_semi")
    return alive.dropDuplicates([id_col, key]).select(*docs.columns)
