"""Global distinct-word shuffle: each distinct word of a corpus meets one task, and what it learns goes back.

A task reads documents in batches of bounded size.  A document becomes the sequence of its words' numbers in the
batch (the position of a number is the position of the word), and the batch's distinct words are dealt by hash into
parts.  So a word crosses the network once for each batch, not once for each occurrence, and a frequent word is no
hot key: it has one row entry for each batch.  The numbers are stored in the shared folder; the words of a part meet
in one task (``answer``), whose answers go back to the batch and are joined to the numbers there (``assemble``).

Rows of the stored table: ``batch, part`` with part -1 for the documents of a batch (``head``: ids, lengths and word
numbers), else a part's distinct words (``words``).
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: UTF-8 bytes of text in a batch (a longer text is a batch of its own).
BATCH_BYTES = 32 << 20
#: The vocabulary is dealt into spark.sql.shuffle.partitions parts, but into so many at least.
LEAST_PARTS = 32
#: Documents are handed on in slices of about so many words.
SLICE_WORDS = 200_000

#: Classes of words by the binary logarithm of their frequency in a batch.
CLASSES = 32

PACKED = "batch long, part int, head binary, words binary"


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    a = np.ascontiguousarray(a, dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_strings(items: list[bytes]) -> bytes:
    lengths = pack_ints(np.fromiter(map(len, items), np.uint32, len(items)))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(items))


def unpack_strings(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:8], "little")
    ends = np.cumsum(unpack_ints(b[8:8 + n]), dtype=np.int64).tolist()
    body = zstandard.ZstdDecompressor().decompress(b[8 + n:])
    return [body[i:j] for i, j in zip([0, *ends], ends)]


def pack_many(*fields: bytes) -> bytes:
    return b"".join(len(f).to_bytes(8, "little") + f for f in fields)


def unpack_many(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at:at + 8], "little")
        out.append(b[at + 8:at + 8 + n])
        at += 8 + n
    return out


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... (count of them) of each range, one range after the other."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts.astype(np.int64) - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Numbers(dict):
    """Word -> its number in the order of first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Split:
    """The texts of a batch as word numbers, by a function text -> (iterable of word numbers) and the dict word -> number that it
    fills; words are bytes or strings."""

    def __init__(self, split, vocabulary: dict):
        self.split, self.vocabulary, self.numbers = split, vocabulary, []

    def add(self, texts: pa.Array) -> None:
        self.numbers += [np.fromiter(self.split(t or ""), np.uint32) for t in texts.to_pylist()]

    def done(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(numbers of all words one after the other, words of each text, the distinct words)."""
        flat = np.concatenate(self.numbers) if self.numbers else np.empty(0, np.uint32)
        return flat, np.fromiter(map(len, self.numbers), np.int64), [w.encode() if isinstance(w, str) else w for w in self.vocabulary]


class SpacedWords:
    """The same for the words between ASCII white space, A-Z lower-cased: they are split and numbered whole columns at a time."""

    def __init__(self):
        self.words, self.lengths = [], [np.empty(0, np.int64)]

    def add(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = lists.flatten()
        some = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word
        before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        self.lengths.append(np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]))
        self.words.append(words.filter(some))

    def done(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        numbered = pa.chunked_array(self.words, pa.string()).dictionary_encode().combine_chunks()
        return numbered.indices.to_numpy().astype(np.uint32), np.concatenate(self.lengths), numbered.dictionary.cast(pa.binary()).to_pylist()


def _heads(ids: list, marks: list, lengths: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> bytes:
    known = np.array([x is not None for x in ids], dtype=np.uint8)
    return pack_many(known.tobytes(), np.array([x or 0 for x in ids], dtype="<i8").tobytes(), np.array(marks, dtype=np.uint8).tobytes(),
                     lengths.astype("<i8").tobytes(), pack_ints(numbers), pack_ints(sizes))


def pack_batches(rows, make_splitter, n_parts: int, batch_bytes: int = BATCH_BYTES, count_words: bool = False):
    """Arrow batches of ``id, mark, text`` -> rows of the packed table.

    ``make_splitter()`` gives what numbers a batch's words (like ``SpacedWords``), or the arguments of ``Split``.  ``mark`` is
    a 0/1 flag of a document.  With ``count_words`` each word is sent with the number of its occurrences in the documents of
    mark 0.
    """
    task = TaskContext.get().partitionId()
    serial = 0

    def flush():
        nonlocal serial, splitter
        flat, lengths, words = splitter.done()
        splitter = None  # and with it its caches, before the batch is sorted
        uses = np.bincount(flat, minlength=len(words))
        # Frequent words get small numbers, which compress well.  Inside a class of like frequency words are numbered by part
        # and spelling, so the numbers of a part's words follow from the sizes of the classes alone.
        spelled = pc.array_sort_indices(pa.array(words, pa.large_binary())).to_numpy().astype(np.int64)
        kind = CLASSES - 1 - np.minimum(np.log2(np.maximum(uses, 1)).astype(np.int64), CLASSES - 1)
        part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n_parts
        short = np.min_scalar_type(n_parts * CLASSES)  # small keys are sorted by radix
        by = lambda key: spelled.take(np.argsort(key.take(spelled).astype(short), kind="stable"))
        rank = np.empty(len(words), np.uint32)
        rank[by(kind * n_parts + part)] = np.arange(len(words), dtype=np.uint32)
        order = by(part * CLASSES + kind)
        sizes = np.bincount(part * CLASSES + kind, minlength=n_parts * CLASSES)
        batch = (task << 33) + serial
        serial += 1
        if count_words:
            seen = np.bincount(flat[np.repeat(np.array(marks) == 0, lengths)], minlength=len(words))
        out = [(batch, -1, _heads(ids, marks, lengths, rank[flat], sizes), None)]
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        for p in range(n_parts):
            own = order[cuts[p]:cuts[p + 1]]
            if len(own):
                fields = [pack_strings([words[i] for i in own])] + ([pack_ints(seen[own])] if count_words else [])
                out.append((batch, p, None, pack_many(*fields)))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                           pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["batch", "part", "head", "words"])

    def fresh():
        made = make_splitter()
        return Split(*made) if isinstance(made, tuple) else made

    splitter, ids, marks, size = fresh(), [], [], 0
    for b in rows:
        for at in range(0, b.num_rows, 256):
            s = b.slice(at, 256)
            i = 0
            sizes = pc.fill_null(pc.utf8_length(s.column(2)), 0).to_pylist()
            while i < len(sizes):
                j = i
                while j < len(sizes) and (size + sizes[j] <= batch_bytes or not (ids or j > i)):
                    size += sizes[j]
                    j += 1
                splitter.add(s.column(2).slice(i, j - i))
                ids += s.column(0).slice(i, j - i).to_pylist()
                marks += [1 if m else 0 for m in s.column(1).slice(i, j - i).to_pylist()]
                if j < len(sizes):
                    yield flush()
                    splitter, ids, marks, size = fresh(), [], [], 0
                i = j
    if ids:
        yield flush()


def pack(spark: SparkSession, docs: DataFrame, make_splitter, name: str, count_words: bool = False,
         batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """Store the packed table of ``docs`` (columns id, mark, text); also the number of parts."""
    n_parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.mapInArrow(lambda it: pack_batches(it, make_splitter, n_parts, batch_bytes, count_words), PACKED)
    return stored(spark, packed, name), n_parts


def answers(packed: DataFrame, n_parts: int, answer) -> DataFrame:
    """``batch, part, body``: what ``answer`` says to the distinct words of each batch and part.

    ``answer(rows)`` gets an iterator over (batch, part, fields) of one task, equal words always in the same task, and
    yields (batch, part, bytes).
    """
    def answered(it):
        def rows():
            for b in it:
                for i, p, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    yield i, p, unpack_many(w.as_py())
        for i, p, out in answer(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([p], pa.int32()), pa.array([out], pa.binary())],
                                             ["batch", "part", "body"])

    words = packed.where("part >= 0").select("batch", "part", "words").repartition(n_parts, "part")
    return words.mapInArrow(answered, "batch long, part int, body binary")


def joined(it, assemble):
    """What ``assemble(head, answers)`` yields for each batch of a task's rows (see ``by_batch``)."""
    head = batch = None
    found: list[bytes] = []
    for b in it:
        for i, p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if i != batch:
                if head is not None:
                    yield from assemble(Head(head), found)
                batch, head, found = i, None, []
            if p < 0:
                head = body.as_py()
            else:
                found.append(body.as_py())
    if head is not None:
        yield from assemble(Head(head), found)


def by_batch(packed: DataFrame, back: DataFrame) -> DataFrame:
    """``batch, part, body``: each batch's documents, followed by the answers to their words."""
    heads = packed.where("part < 0").select("batch", "part", F.col("head").alias("body"))
    return heads.unionByName(back).repartition("batch").sortWithinPartitions("batch", "part")


def assembled(packed: DataFrame, back: DataFrame, assemble, schema) -> DataFrame:
    """Documents joined with the answers to their words.

    ``assemble(head, answers)`` gets a batch's documents and its parts' answers in order and yields Arrow batches of
    ``schema``.
    """
    return by_batch(packed, back).mapInArrow(lambda it: joined(it, assemble), schema)


class Head:
    """The documents of a batch."""

    def __init__(self, body: bytes):
        known, ids, marks, lengths, numbers, self._sizes = unpack_many(body)
        known = np.frombuffer(known, np.uint8)
        self.ids = [i if k else None for i, k in zip(np.frombuffer(ids, "<i8").tolist(), known.tolist())]
        self.marks = np.frombuffer(marks, np.uint8)
        self.lengths = np.frombuffer(lengths, "<i8")
        self.numbers = unpack_ints(numbers)

    def order(self) -> np.ndarray:
        """The word number of each answered word, in the order of the answers."""
        sizes = unpack_ints(self._sizes).astype(np.int64).reshape(-1, CLASSES)
        by_class = np.cumsum(sizes.T.reshape(-1)).reshape(sizes.T.shape).T
        return gather((by_class - sizes).reshape(-1), sizes.reshape(-1))

    def slices(self, most: int = SLICE_WORDS):
        """(first document, end document, first word, end word) of slices of about ``most`` words."""
        ends = np.cumsum(self.lengths)
        i = 0
        while i < len(ends):
            start = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield i, j, int(start), int(ends[j - 1])
            i = j


def flatten(lists) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32)
