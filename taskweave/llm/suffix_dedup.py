"""Byte-exact removal of repeated strings by merging Burrows-Wheeler transforms of shards.

A byte goes if it lies in a string of ``length`` bytes that also stands in a document with a smaller id.

1. Every string of ``length`` bytes names one of its short grams as its anchor (the one with the least hash, the leftmost
   of equals), so equal strings have equal anchors at the same place.  Consecutive strings with one anchor are a run.
   Documents are kept in batches; a batch sends each distinct anchor once, as 5 bytes, to the part of its hash, and learns
   whether it stands in another document too (``met_again``).  Only runs whose anchor does go on.
2. The text of such a run (a segment: its strings overlap, so this is less than twice ``length``) goes to the part of its
   anchor, each distinct segment of a batch once, with the smallest id that has it there.  So all equal strings meet.
   An anchor with very many occurrences would overfill its part: its strings are dealt one by one, by their own hash.
3. A part's segments are the collection of a generalised suffix array, built in shards (``Shard``: suffix order and
   Burrows-Wheeler transform of some segments).  The transforms are merged without sorting suffixes again
   (``interleave``): starting from all shards one after the other, each pass reads the transforms along the present
   interleaving and deals the rows stably by symbol, after which rows are in order of one more symbol.  Rows that are still
   together after ``length`` passes share a prefix of that length: the boundaries that the passes leave are the
   places where the common prefix is shorter.  So each repeated string is an interval of rows, whose smallest document stays.
4. The answers go back to the batches, which cut the strings out.

Documents travel once more for steps 2 and 4, compressed; nothing is held in one task but a batch or a part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .word_exchange import gather, pack_many, unpack_many

#: Bytes of a repeated string, and of the gram that anchors it (at most 26 less, so that a segment is short).
LENGTH, GRAM = 50, 24
#: Bytes of text in a batch (a longer text is a batch of its own) and in a part, on average; least number of parts.
BATCH_BYTES, PART_BYTES, LEAST_PARTS = 8 << 20, 64 << 20, 32
#: Strings of an anchor with more occurrences are dealt one by one.
HOT = 1 << 14
#: Segment bytes that are merged at a time (segments of one anchor stay together), and shards in which they are sorted.
MERGE_BYTES, SHARDS = 1 << 18, 4
#: Positions whose anchors are found at a time.
STRIDE = 1 << 17
PACKED = "batch long, n_bytes long, body binary"
ROWS = "batch long, kind int, part int, body binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
LAST = (1 << 63) - 1
ONCE, AGAIN, OFTEN = 0, 1, 2
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def arrow(schema: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (8 at least) bytes at each place."""
    n = len(text) - gram + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = mixed((h ^ words[at:at + n]) * M1)
    return h


class Runs:
    """The runs of a batch: ``starts`` and ``counts`` of their strings, ``keys`` of their anchors, ``docs`` they are in."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, length: int, gram: int):
        ends = np.cumsum(sizes)
        wide = length - gram + 1
        found = [(np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)]
        for at in range(0, len(text) - length + 1, STRIDE):
            h = gram_hashes(text[at:at + STRIDE + length - 1], gram)
            # the least hash of each window of grams, the leftmost of equals: high bits of the hash, then the place
            least = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= wide:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < wide:
                least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
            a, z = np.searchsorted(ends, [at, at + len(least)], side="right")
            bounds = ends[a:z + 1]
            begin = np.arange(at, at + len(least))
            limit = bounds[np.searchsorted(bounds, begin, side="right").clip(max=len(bounds) - 1)]
            begin = np.flatnonzero(begin + length <= limit)
            place = (least[begin] & np.uint64(0xFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(begin) != 1)][:len(begin)])
            found.append((begin[new] + at, np.diff(np.append(new, len(begin))), mixed(h[place[new]] * M1)))
        self.starts, self.counts, self.keys = (np.concatenate(x) for x in zip(*found))
        self.docs = np.searchsorted(ends, self.starts, side="right")


def place_of(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and 32-bit code of keys."""
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)


class Batch:
    """Documents of a batch: ``ids`` (null: the last), ``known``, ``sizes`` and the ``text`` of all, one after the other."""

    def __init__(self, body: bytes):
        known, ids, sizes, text = unpack_many(body)
        self.known, self.ids = np.frombuffer(known, np.uint8), np.frombuffer(ids, "<i8")
        self.sizes = np.frombuffer(sizes, "<i8")
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)

    @staticmethod
    def pack(ids: list, texts: list[bytes]) -> bytes:
        known = np.array([i is not None for i in ids], np.uint8)
        return pack_many(known.tobytes(), np.array([LAST if i is None else i for i in ids], "<i8").tobytes(),
                         np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts)))


def anchors(runs: Runs, n_parts: int):
    """Distinct anchors of a batch in order of part and key: the runs in that order, the groups' first places and the parts."""
    order = np.argsort(runs.keys << np.uint64(32) | runs.keys >> np.uint64(32), kind="stable")  # parts ascend with the low bits
    key = runs.keys[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return order, first, place_of(key[first], n_parts)[0]


def by_part(parts: np.ndarray):
    """(part, first, end) of each stretch of equal parts."""
    cuts = np.flatnonzero(np.r_[True, np.diff(parts) != 0][:len(parts)])
    return zip(parts[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(parts)).tolist())


def grouped(it, n_key: int):
    """Rows of sorted Arrow batches in groups that agree in the first ``n_key`` columns: (key, list of the other columns)."""
    key, rows = None, []
    for b in it:
        columns = [b.column(i) for i in range(b.num_columns)]
        for i in range(b.num_rows):
            row = [c[i].as_py() for c in columns]
            if row[:n_key] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_key], []
            rows.append(row[n_key:])
    if rows:
        yield key, rows


def met_again(codes: np.ndarray, several: np.ndarray, times: np.ndarray, hot: int) -> np.ndarray:
    """For each entry (a batch's anchor): whether the anchor stands in one document only, in more, or very often."""
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0][:len(order)])
    if not len(first):
        return np.empty(0, np.uint8)
    sizes = np.diff(np.append(first, len(order)))
    again = (sizes > 1) | np.logical_or.reduceat(several[order], first)
    often = np.add.reduceat(times[order], first) > hot
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(np.where(again, np.where(often, OFTEN, AGAIN), ONCE).astype(np.uint8), sizes)
    return out


class Segments:
    """What a batch asks: its distinct segments by part, each with the smallest id that has it."""

    def __init__(self, batch: Batch, runs: Runs, kinds: np.ndarray, n_parts: int, length: int):
        self.batch, self.runs = batch, runs
        raw = batch.text.tobytes()
        again, often = np.flatnonzero(kinds == AGAIN), np.flatnonzero(kinds == OFTEN)
        # strings of very frequent anchors, each a run of its own
        each = gather(runs.starts[often], runs.counts[often])
        self.starts = np.concatenate([runs.starts[again], each])
        self.counts = np.concatenate([runs.counts[again], np.ones(len(each), np.int64)])
        self.docs = np.concatenate([runs.docs[again], np.repeat(runs.docs[often], runs.counts[often])])
        numbers: dict[bytes, int] = {}
        digest = xxhash.xxh3_64_intdigest
        self.number = np.empty(len(self.starts), np.int64)  # of the segment of each run
        keys: list[int] = runs.keys[again].tolist()
        own: list[int] = []
        for i, (a, n) in enumerate(zip(self.starts.tolist(), self.counts.tolist())):
            segment = raw[a:a + n + length - 1]
            k = numbers.get(segment)
            if k is None:
                numbers[segment] = k = len(numbers)
                own.append(keys[i] if i < len(keys) else digest(segment))
            self.number[i] = k
        self.texts = list(numbers)
        self.keys = np.array(own, np.uint64)
        self.least = np.full(len(numbers), LAST, np.int64)
        np.minimum.at(self.least, self.number, batch.ids[self.docs])
        self.strings = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) - (length - 1)
        part, _ = place_of(self.keys, n_parts)
        self.order = np.argsort(part, kind="stable")
        self.parts = part[self.order]

    def questions(self):
        """(part, body) for each part."""
        for p, i, j in by_part(self.parts):
            own = self.order[i:j]
            yield p, pack_many(place_of(self.keys[own], 1)[1].tobytes(), self.least[own].astype("<i8").tobytes(),
                               self.strings[own].astype("<u4").tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join([self.texts[k] for k in own])))

    def removed(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings that go, ascending, and the documents they are in."""
        ends = np.cumsum(self.strings)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        for (_, i, j), answer in zip(by_part(self.parts), answers, strict=True):
            own = self.order[i:j]
            places = gather((ends - self.strings)[own], self.strings[own])
            bits[places] = np.unpackbits(np.frombuffer(answer, np.uint8), count=len(places)).astype(bool)
        at = gather((ends - self.strings)[self.number], self.counts)
        later = np.repeat(self.batch.ids[self.docs] > self.least[self.number], self.counts)
        gone = np.flatnonzero(bits[at] | later)
        starts, docs = gather(self.starts, self.counts)[gone], np.repeat(self.docs, self.counts)[gone]
        order = np.argsort(starts)
        return starts[order], docs[order]


class Shard:
    """Suffix order and Burrows-Wheeler transform of segments that each end with a symbol of its own.

    ``alphabet`` maps bytes to symbols from 1 on; the ends are 0 and are ordered as their segments are.  A segment counts as
    a ring: its end stands before its first symbol.  ``transform`` is the symbol before each suffix, ``before`` the one
    before that.
    """

    PACK = 7  # symbols of 9 bits in a long

    def __init__(self, texts: list[bytes], alphabet: np.ndarray):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes) - 1
        symbols = np.zeros(int(sizes.sum()), np.uint16)
        inner = np.ones(len(symbols), bool)
        inner[ends] = False
        symbols[inner] = alphabet[np.frombuffer(b"".join(texts), np.uint8)]
        self.order = self._sorted(symbols, np.repeat(ends, sizes))
        back = np.arange(-1, len(symbols) - 1)
        back[ends - sizes + 1] = ends
        one = back[self.order]
        self.transform, self.before = symbols[one], symbols[back[one]]
        self.lasts = symbols[ends - 1]

    def _sorted(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Prefix doubling from packed symbols; a suffix that reaches its end is told apart from all others."""
        n = len(symbols)
        place = np.arange(n)
        padded = np.append(symbols.astype(np.int64), np.zeros(self.PACK, np.int64))
        key = np.zeros(n, np.int64)
        for i in range(self.PACK):
            key = key << 9 | np.where(place + i <= ends, padded[i:i + n], 0)
        order = np.argsort(key, kind="stable")
        done = (place + self.PACK > ends)[order]  # the end is among the symbols
        new = np.r_[True, (np.diff(key[order]) != 0) | done[1:] | done[:-1]][:n]
        depth = self.PACK
        rank = np.empty(n, np.int64)
        while True:
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            rank[order] = first[group]  # rows before the group: stays true when groups are split
            sizes = np.diff(np.append(first, n))
            tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(tied):
                return order
            own = order[tied]
            both = rank[own] * (n + 1) + rank[np.minimum(own + depth, n - 1)]
            at = np.argsort(both, kind="stable")
            order[tied] = own[at]
            both = both[at]
            new[tied] = np.r_[True, np.diff(both) != 0]
            depth *= 2


def interleave(shards: list[Shard], length: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of each row and a mark where a row's common prefix with the row before is shorter than
    ``length``; a shard's rows keep their order.

    A pass reads two symbols at a time (one, for an odd length) and deals the rows by them.  Rows that begin with an end,
    or with one symbol and an end, are told apart by their segments, so their places are fixed.
    """
    n = sum(len(s.order) for s in shards)
    number = np.arange(len(shards), dtype=np.uint8)
    of_end = np.repeat(number, [len(s.lasts) for s in shards])
    lasts = np.concatenate([s.lasts for s in shards])
    kind = np.uint16 if n_symbols <= 256 else np.uint32  # 16 bits are dealt by counting
    pairs = [s.before.astype(kind) * kind(n_symbols) + s.transform.astype(kind) for s in shards]
    dealt = np.sort(np.concatenate(pairs))
    new_symbol = np.r_[True, dealt[1:] != dealt[:-1]]
    by_last = np.flatnonzero((dealt % kind(n_symbols) == 0) & (dealt > 0))  # one symbol and an end
    of_last = of_end[np.argsort(lasts, kind="stable")]
    source = np.repeat(number, [len(s.order) for s in shards])
    block = np.zeros(n, np.int32)
    new = np.zeros(n, bool)

    def deal(symbols, changes):
        nonlocal source, block
        symbol = np.empty(n, symbols[0].dtype)
        for k, own in enumerate(symbols):
            symbol[source == k] = own
        row = np.argsort(symbol, kind="stable")
        source, block = source[row], block[row]
        source[:len(of_end)] = of_end  # ends come first, in the order of their segments
        np.not_equal(block[1:], block[:-1], out=new[1:])
        np.logical_or(new, changes, out=new)
        new[:len(of_end) + 1] = True

    if length % 2:
        single = [s.transform for s in shards]
        first = np.sort(np.concatenate(single))
        deal(single, np.r_[True, first[1:] != first[:-1]])
        np.cumsum(new, dtype=np.int32, out=block)
    for _ in range(length // 2):
        deal(pairs, new_symbol)
        source[by_last] = of_last
        new[by_last] = True
        np.cumsum(new, dtype=np.int32, out=block)
    return source, new


def least_holders(texts: list[bytes], least: np.ndarray, length: int, n_shards: int = SHARDS) -> np.ndarray:
    """For each string of ``length`` bytes in the segments, one segment after the other, the smallest id of the segments
    that hold it (``least``: a segment's own)."""
    known = np.flatnonzero(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    alphabet = np.zeros(256, np.uint16)
    alphabet[known] = np.arange(1, len(known) + 1)
    cuts = np.linspace(0, len(texts), min(n_shards, len(texts)) + 1).astype(int).tolist()
    shards = [Shard(texts[i:j], alphabet) for i, j in zip(cuts, cuts[1:])]
    source, new = interleave(shards, length, len(known) + 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    total = int(sizes.sum())
    position = np.empty(total, np.int64)
    at = 0
    for k, s in enumerate(shards):
        position[source == k] = s.order + at
        at += len(s.order)
    strings = sizes - length
    begin = np.cumsum(sizes) - sizes
    asked = np.full(total, -1, np.int64)  # number of the string that starts at a place
    asked[gather(begin, strings)] = np.arange(int(strings.sum()))
    ids = np.repeat(least, strings)
    interval = np.cumsum(new) - 1
    number = asked[position]
    rows = np.flatnonzero(number >= 0)
    number, interval = number[rows], interval[rows]
    first = np.flatnonzero(np.r_[True, np.diff(interval) != 0])
    lowest = np.minimum.reduceat(ids[number], first)
    out = np.empty(len(ids), np.int64)
    out[number] = np.repeat(lowest, np.diff(np.append(first, len(number))))
    return out


def answered(rows: list, length: int, merge_bytes: int) -> list[bytes]:
    """Bodies of a part's questions -> for each a bit for every string: a smaller id than the segment's own holds it."""
    fields = [unpack_many(body) for body in rows]
    codes = np.concatenate([np.frombuffer(f[0], "<u4") for f in fields])
    least = np.concatenate([np.frombuffer(f[1], "<i8") for f in fields])
    strings = np.concatenate([np.frombuffer(f[2], "<u4") for f in fields]).astype(np.int64)
    numbers: dict[bytes, int] = {}
    which = np.empty(len(codes), np.int64)
    i = 0
    for f in fields:  # equal segments of several batches are one
        raw = zstandard.ZstdDecompressor().decompress(f[3])
        at = 0
        for n in (np.frombuffer(f[2], "<u4").astype(np.int64) + (length - 1)).tolist():
            which[i] = numbers.setdefault(raw[at:at + n], len(numbers))
            at += n
            i += 1
    texts = list(numbers)
    lowest = np.full(len(texts), LAST, np.int64)
    np.minimum.at(lowest, which, least)
    code = np.empty(len(texts), np.uint32)
    code[which] = codes
    order = np.argsort(code, kind="stable")
    sizes = np.fromiter((len(texts[k]) for k in order), np.int64, len(order))
    # cut between anchors, at about merge_bytes
    chunk = (np.cumsum(sizes) - sizes) // merge_bytes
    heads = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    chunk = np.repeat(chunk[heads], np.diff(np.append(heads, len(order))))
    # a segment alone with its anchor shares no string with others
    bits: list = [np.zeros(len(t) - (length - 1), bool) for t in texts]
    shared = np.repeat(np.diff(np.append(heads, len(order))) > 1, np.diff(np.append(heads, len(order))))
    order, sizes, chunk = order[shared], sizes[shared], chunk[shared]
    for _, i, j in by_part(chunk):
        own = order[i:j]
        holders = least_holders([texts[k] for k in own], lowest[own], length)
        n = sizes[i:j] - (length - 1)
        smaller = holders < np.repeat(lowest[own], n)
        ends = np.cumsum(n).tolist()
        for k, a, z in zip(own.tolist(), [0, *ends], ends):
            bits[k] = smaller[a:z]
    out, i = [], 0
    for f in fields:
        j = i + len(f[0]) // 4
        later = least[i:j] > lowest[which[i:j]]
        flags = np.concatenate([bits[k] for k in which[i:j].tolist()]) | np.repeat(later, strings[i:j])
        out.append(np.packbits(flags).tobytes())
        i = j
    return out


def spans(starts: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, document) of the maximal runs of bytes under the strings, ascending."""
    new = np.flatnonzero(np.r_[True, (np.diff(starts) > length) | (np.diff(docs) != 0)][:len(starts)])
    last = np.append(new[1:], len(starts))[:len(new)] - 1
    return starts[new], starts[last] + length, docs[new]


def pack_documents(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """``doc_id, text`` -> rows of ``PACKED``."""
    def batches(it):
        task, serial = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = (t.as_py() or "").encode()
                if ids and size + len(t) > batch_bytes:
                    yield arrow(PACKED, [(task << 33) + serial], [size], [Batch.pack(ids, texts)])
                    serial += 1
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield arrow(PACKED, [(task << 33) + serial], [size], [Batch.pack(ids, texts)])

    return docs.mapInArrow(batches, PACKED)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) for every document.

    Texts are UTF-8 bytes.  Every byte goes that is covered by a string of ``length`` bytes that also starts in a document
    with a smaller id; strings are those of the input, so what has gone elsewhere still counts.  Matches never cross documents; repeats inside
    one document stay.  ``n_spans`` counts the maximal runs of removed bytes.  Bytes are cut, so a cut may part a character.

    Nulls: a null text is empty; a null id comes after all known ones, so its repeats go (the largest long counts as null).
    Rows of one id are not earlier than each other.  Texts shorter than ``length`` and empty ones stay whole.  A very long
    text is a batch of its own.  Repeated rows give a row each, empty tables an empty result; other columns are not read.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and as many as a string at most")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = stored(spark, pack_documents(narrow, batch_bytes), "suffix-batches")
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    n_parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    texts = packed.select("batch", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "body")

    def ask_anchors(it):
        for (number, _, _), ((body,),) in grouped(it, 3):
            batch = Batch(body)
            runs = Runs(batch.text, batch.sizes, length, gram)
            order, first, parts = anchors(runs, n_parts)
            if not len(first):
                continue
            times = np.diff(np.append(first, len(order)))
            docs = runs.docs[order]
            several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            code = place_of(runs.keys[order[first]], n_parts)[1].astype("<u4")
            weight = (np.ceil(np.log2(times)).astype(np.uint8) | several.astype(np.uint8) << np.uint8(7))
            out = [(number, 0, p, pack_many(code[i:j].tobytes(), weight[i:j].tobytes())) for p, i, j in by_part(parts)]
            yield arrow(ROWS, *zip(*out))

    def answer_anchors(it):
        for (part,), rows in grouped(it, 1):
            fields = [unpack_many(body) for _, body in rows]
            codes = np.concatenate([np.frombuffer(f[0], "<u4") for f in fields])
            weight = np.concatenate([np.frombuffer(f[1], np.uint8) for f in fields])
            kinds = met_again(codes, weight >= 128, 1 << (weight & 127).astype(np.int64), hot)
            at = 0
            for (number, _), f in zip(rows, fields):
                n = len(f[1])
                yield arrow(ROWS, [number], [0], [part], [zstandard.ZstdCompressor(level=1).compress(kinds[at:at + n].tobytes())])
                at += n

    def at_parts(rows):
        return rows.select("part", "batch", "body").repartition(n_parts, "part").sortWithinPartitions("part", "batch")

    def segments_of(rows):
        """(batch number, Segments, answers) of a task's batches, their documents first, then the answers."""
        for (number,), own in grouped(rows, 1):
            batch = Batch(own[0][2])
            runs = Runs(batch.text, batch.sizes, length, gram)
            order, first, _ = anchors(runs, n_parts)
            kinds = np.zeros(len(runs.keys), np.uint8)
            if len(first):
                said = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(body) for kind, _, body in own if kind == 0), np.uint8)
                kinds[order] = np.repeat(said, np.diff(np.append(first, len(order))))
            yield number, Segments(batch, runs, kinds, n_parts, length), [body for kind, _, body in own if kind == 1]

    def ask_segments(it):
        for number, segments, _ in segments_of(it):
            out = [(number, 1, p, body) for p, body in segments.questions()]
            if out:
                yield arrow(ROWS, *zip(*out))

    def answer_segments(it):
        for (part,), rows in grouped(it, 1):
            for (number, _), body in zip(rows, answered([body for _, body in rows], length, merge_bytes)):
                yield arrow(ROWS, [number], [1], [part], [body])

    def cut(it):
        for _, segments, answers in segments_of(it):
            batch = segments.batch
            first, end, doc = spans(*segments.removed(answers), length)
            text = batch.text.tobytes()
            ends = np.cumsum(batch.sizes)
            cuts = np.searchsorted(doc, np.arange(len(ends) + 1)).tolist()
            first, end = first.tolist(), end.tolist()
            out, size = [], 0
            for k, (z, n) in enumerate(zip(ends.tolist(), batch.sizes.tolist())):
                i, j = cuts[k], cuts[k + 1]
                pieces = [text[a:b] for a, b in zip([z - n, *end[i:j]], [*first[i:j], z])]
                kept = b"".join(pieces)
                out.append((int(batch.ids[k]) if batch.known[k] else None, n, n - len(kept), j - i, kept))
                size += len(kept)
                if size > batch_bytes // 4:
                    yield arrow(RESULT, *zip(*out))
                    out, size = [], 0
            if out:
                yield arrow(RESULT, *zip(*out))

    def at_batches(rows):
        return rows.repartition("batch").sortWithinPartitions("batch", "kind", "part")

    seen = stored(spark, at_parts(texts.mapInArrow(ask_anchors, ROWS)).mapInArrow(answer_anchors, ROWS), "suffix-anchors")
    told = texts.unionByName(seen)
    asked = at_batches(told).mapInArrow(ask_segments, ROWS)
    found = at_parts(asked).mapInArrow(answer_segments, ROWS)
    return at_batches(told.unionByName(found)).mapInArrow(cut, RESULT)


def digests(kept: DataFrame) -> DataFrame:
    """The documents of ``remove_repeats`` with ``kept_sha256`` (lowercase hex) instead of the bytes."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
