"""Quality rules: base counters and the divergence of a document's histograms from its language's references.

A language's references are the shares of character classes and of its common words, counted over all documents of the
language.  A document is kept if the Jensen-Shannon distances (base 2, so 0 to 1) of its own histograms stay below bounds
that allow for the noise of short texts, and texts below a minimum length aren't compared at all.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_name, stored

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "beyond_ascii")
SENTENCE = b".,;:!?'\"()-"
JUDGED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, class_distance double, word_distance double")
#: Languages whose references are broadcast, the largest; those of the others are joined to their documents.
BROADCAST_LANGS = 1000


@dataclass(frozen=True)
class Limits:
    """All parameters of the rules."""

    min_words: int = 10                 # base rule: fewer words fail
    repeat_window: int = 5              # base rule: words in windows of so many words that occur again in the text ...
    most_repeated: int = 20             # ... fail above so many per cent of all words
    common_words: int = 100             # words of a language's histogram, the most frequent; all others share one bin
    least_share: float = 0.0            # a language with a smaller share of all words has no reference (none by default)
    least_words: int = 500              # a language with fewer words in all its documents has no reference
    class_chars: int = 200              # shorter texts (code points) aren't compared by character class
    class_distance: tuple = (0.2, 3.0)  # bound a + b / sqrt(characters)
    word_words: int = 50                # texts with fewer words aren't compared by common words
    word_distance: tuple = (0.15, 4.0)  # bound a + b / sqrt(words)


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"))
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [32, *range(9, 14)]),
                        ("sentence", SENTENCE)):
        table[list(chars)] = CLASSES.index(name)
    return table


CLASS_OF = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    """Code points of each class in UTF-8 text."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out = np.bincount(CLASS_OF[:128], weights=by_byte[:128], minlength=len(CLASSES))
    out[-1] = by_byte[192:].sum()  # lead bytes of longer sequences
    return out


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in windows of ``window`` words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    bits = max(1, (len(numbers) - 1).bit_length())
    key = a[:n - window + 1].copy()
    held = bits
    for i in range(1, window):
        if held + bits > 62:  # number the windows so far anew, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            held = n.bit_length()
        key = (key << bits) | a[i:n - window + 1 + i]
        held += bits
    in_order = np.sort(key)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms (counts or shares, each with a positive sum)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def divergence(x):
        on = x > 0
        return float(np.sum(x[on] * np.log2(x[on] / m[on])))

    return float(np.sqrt(max(0.0, (divergence(p) + divergence(q)) / 2)))


def references(spark: SparkSession, docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``known, size, body``: each language with a reference, its words, and the reference (see ``reference``), over all documents.

    Each task counts its words by language and hands its counts on now and then; they are summed by (language, word), so
    a language or word with a third of all rows is no hot key.  Only the most frequent words of each language (``common_words``,
    ties by word) leave the sum.  A null language is one of its own.
    """
    def count(it):
        words: dict = {}
        classes: dict = {}
        size = 0

        def rows():
            out = [(lang, w.decode(), None, n) for lang, c in words.items() for w, n in c.items()]
            out += [(lang, None, i, int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))],
                                              ["lang", "word", "class", "n"])

        for b in it:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for lang, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    raw = (text or "").encode()
                    found = raw.lower().split()
                    own = words.setdefault(lang, Counter())
                    own.update(found)
                    if lang not in classes:
                        classes[lang] = np.zeros(len(CLASSES) + 1)
                    classes[lang][:-1] += class_counts(raw)
                    classes[lang][-1] += len(found)
                    size += len(raw)
                if size > 64 << 20 or sum(map(len, words.values())) > 500_000:
                    yield rows()
                    words, classes, size = {}, {}, 0
        if classes:
            yield rows()

    counted = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
               .mapInArrow(count, "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.desc("n"), "word", "class")
    # a literal bound lets every task cut its own counts before they are dealt by language
    bound = max(limits.common_words, len(CLASSES) + 1)
    most = stored(spark, counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bound), "quality-counts")
    is_size = F.col("class") == len(CLASSES)
    whole = most.groupBy(F.col("lang").alias("known")).agg(
        F.max(F.when(is_size, F.col("n"))).alias("size"),
        F.to_json(F.struct(F.max(F.when(is_size, F.col("n"))).alias("size"),
                           F.collect_list(F.when(F.col("class") < len(CLASSES), F.struct("class", "n"))).alias("classes"),
                           F.sort_array(F.collect_list(F.when(F.col("word").isNotNull() & (F.col("place") <= limits.common_words),
                                                              F.struct("place", "word", "n")))).alias("words"))).alias("body"))
    whole = whole.where(F.col("size") >= limits.least_words)
    if limits.least_share > 0:
        everything = most.where(is_size).agg(F.sum("n")).first()[0] or 0
        whole = whole.where(F.col("size") >= limits.least_share * everything)
    return stored(spark, whole, "quality-references")


def reference(body: str) -> tuple:
    """Character-class counts, common word -> its bin, common-word histogram."""
    found = json.loads(body)
    classes = np.zeros(len(CLASSES))
    for c in found["classes"]:
        classes[c["class"]] = c["n"]
    n = [w["n"] for w in found["words"]]
    return classes, {w["word"].encode(): i for i, w in enumerate(found["words"])}, np.array([*n, found["size"] - sum(n)], float)


def with_references(spark: SparkSession, docs: DataFrame, limits: Limits, text_col: str, lang_col: str, name: str):
    """``docs`` with the reference body of its language in a column ``name``, and a broadcast language -> reference.

    The references of the ``BROADCAST_LANGS`` languages with most words are broadcast, and the body of their documents is
    null.  Any other language has at most one of so many parts of all words, so joining by language makes no hot key.
    """
    refs = references(spark, docs, limits, text_col, lang_col)
    order = [F.desc("size"), F.col("known")]
    found = refs.orderBy(*order).limit(BROADCAST_LANGS).collect()
    shared = spark.sparkContext.broadcast({r["known"]: reference(r["body"]) for r in found})
    none = F.lit(None).cast("string").alias(name)
    if len(found) < BROADCAST_LANGS:
        return docs.select("*", none), shared
    lang = F.col(lang_col).cast("string")
    top = [r["known"] for r in found if r["known"] is not None]
    first = lambda c: F.coalesce(c.isin(top), F.lit(len(top) < len(found)))
    known, body = new_name(docs, "__known"), F.col("body").alias(name)
    others = refs.where(~first(F.col("known"))).select(F.col("known").alias(known), body)
    rare = docs.where(~first(lang)).join(others, lang.eqNullSafe(F.col(known)), "left").drop(known)
    return docs.where(first(lang)).select("*", none).unionByName(rare), shared


def judge_texts(texts, langs, bodies, refs: dict, limits: Limits) -> list[tuple]:
    """``judge_text`` of each text, by the reference in its body if it has one, else by that of ``refs``."""
    own = {body: reference(body) for body in set(bodies) if body is not None}
    return [judge_text(t, lang, refs if body is None else {lang: own[body]}, limits) for t, lang, body in zip(texts, langs, bodies)]


def judge_text(text: str | None, lang: str | None, refs: dict, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    classes = class_counts(raw)
    chars = int(classes.sum())
    repeat = repeated_words(words, limits.repeat_window)
    failed = n < limits.min_words or 100 * repeat > limits.most_repeated * n
    by_class = by_word = None
    if lang in refs:
        ref_classes, bins, ref_words = refs[lang]
        if chars >= limits.class_chars:
            by_class = js_distance(classes, ref_classes)
        if n >= limits.word_words:
            common = [i for w in raw.lower().split() if (i := bins.get(w)) is not None]
            histogram = np.bincount(np.array(common, np.int64), minlength=len(ref_words)).astype(float)
            histogram[-1] = n - len(common)
            by_word = js_distance(histogram, ref_words)
    far = (by_class is not None and by_class > limits.class_distance[0] + limits.class_distance[1] / chars ** 0.5
           or by_word is not None and by_word > limits.word_distance[0] + limits.word_distance[1] / n ** 0.5)
    return (n, chars - int(classes[CLASSES.index("space")]), sum(raw.count(bytes([c])) for c in SYMBOLS), dup_lines(raw), repeat, failed,
            not (failed or far), by_class, by_word)


def judge(spark: SparkSession, docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """The counters and the verdict of every document (columns of ``JUDGED``), a row for each input row.

    ``base_failed``: under ``min_words`` words, or too many words in repeated windows.  ``kept`` is false if it failed, or
    if a distance is above its bound.  Distances are null where a guard (length, language without reference) holds; such
    documents are kept unless the base rules fail.  Nulls: a null text counts as empty (and fails), a null language is one
    of its own, null and repeated ids are kept.  Words are compared as bytes; A-Z is lower-cased for the common words.
    An empty table gives an empty result.  Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).cast("string").alias("text"))
    ready, shared = with_references(spark, narrow, limits, "text", "lang", "body")
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def rows(it):
        for b in it:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                lang, text, body = (s.column(i).to_pylist() for i in (1, 2, 3))
                found = judge_texts(text, lang, body, shared.value, limits)
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), types))], names)

    return ready.mapInArrow(rows, JUDGED)


def drop_rejected(spark: SparkSession, docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    body = new_name(docs, "__reference")
    ready, shared = with_references(spark, docs, limits, text_col, lang_col, body)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series, langs: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([v[6] for v in judge_texts(texts, langs, bodies, shared.value, limits)], dtype=bool)

    mark = new_name(docs, "__kept")
    return (ready.withColumn(mark, kept(F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(body))).where(F.col(mark))
            .select(*docs.columns))
