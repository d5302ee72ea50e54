"""Byte-level BPE encoding and decoding over a global distinct-word shuffle."""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .word_exchange import Numbers, answers, assembled, flatten, gather, pack, pack_ints, pack_many, unpack_ints, unpack_many, unpack_strings

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words longer than this are merged with a heap.
SHORT = 48
#: The cache of pieces between spaces is emptied beyond so many entries (some 200 bytes each).
PIECES = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the adjacent pair of lowest rank (the leftmost of equals) is merged until none is known."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of pairs over a linked list of parts."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # the part that starts at i ends at end[i]; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[left[i]:stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def unicode_space(pattern: str) -> str:
    r"""``pattern`` with \s and \S as Unicode's White_Space, as the public tokenizers read them."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Chunks(dict):
    """A piece between two single spaces -> the numbers of the words of ' ' + piece."""

    def __init__(self, find, numbers):
        super().__init__()
        self.find, self.numbers = find, numbers

    def __missing__(self, piece):
        self[piece] = out = tuple([self.numbers[w] for w in self.find(" " + piece)])
        return out


def word_splitter(pattern: str):
    """Text -> numbers of the matches of ``pattern``, with a cache over the pieces between single spaces.

    With the pre-token pattern of the public byte-level vocabularies a match never spans the place before a space that
    ends a run of white space or begins one, and what is matched on either side doesn't depend on the other.  A text
    with a space inside a run of white space (or at the end of one that ends the text) is matched as a whole.
    """
    find, inside = regex.compile(unicode_space(pattern)).findall, regex.compile(r"\s (?:\s|\Z)").search
    numbers = Numbers()
    chunks = Chunks(find, numbers)

    def split(text: str):
        if inside(text):
            return map(numbers.__getitem__, find(text))
        if len(chunks) > PIECES:
            chunks.clear()
        first, *rest = text.split(" ")
        return chain([numbers[w] for w in find(first)], chain.from_iterable(map(chunks.__getitem__, rest)))

    return split, numbers


def encode(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text", rows=None, schema: str = ENCODED) -> DataFrame:
    """``doc_id, ids`` for every document: the BPE ids of each match of ``pattern``, in order.

    Each distinct word of the corpus is encoded once (see ``word_exchange``); its ids are joined back to the batches
    that hold it and put in place by the word numbers.  The vocabulary is broadcast: its size doesn't depend on the data.

    Nulls: a null text counts as empty and gives an empty array; null and repeated doc_ids are kept, a row for each input
    row.  Very long texts are batches of their own, very long words are merged with a heap.  Empty tables give an empty
    result.  Other columns are not read.  ``rows`` maps (ids of documents, Arrow array of id lists) to Arrow batches of
    ``schema``, if the id lists themselves are not wanted.
    """
    shared = spark.sparkContext.broadcast(ranks)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("mark"), F.col(text_col).cast("string").alias("text"))
    packed, n_parts = pack(spark, narrow, lambda: word_splitter(pattern), "bpe-words")
    make = rows or (lambda ids, lists: [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "ids"])])

    def answer(parts):
        known: dict[bytes, list[int]] = {}
        ranked = shared.value
        for batch, part, (words,) in parts:
            found = []
            for w in unpack_strings(words):
                ids = known.get(w)
                if ids is None:
                    known[w] = ids = merge(w, ranked)
                found.append(ids)
            yield batch, part, pack_many(pack_ints(np.fromiter(map(len, found), np.uint32, len(found))), pack_ints(flatten(found)))

    def assemble(head, found):
        fields = [unpack_many(a) for a in found]
        none = [np.empty(0, np.uint32)]
        counts = np.concatenate(none + [unpack_ints(f[0]) for f in fields]).astype(np.int64)
        flat = np.concatenate(none + [unpack_ints(f[1]) for f in fields]).astype(np.int32)
        order = head.order()
        start = np.empty(len(order), np.int64)
        count = np.empty(len(order), np.int64)
        start[order], count[order] = np.cumsum(counts) - counts, counts
        for i, j, a, b in head.slices():
            numbers = head.numbers[a:b]
            each = count[numbers]
            ids = flat[gather(start[numbers], each)]
            totals = np.concatenate([[0], np.cumsum(each)])
            ends = totals[np.concatenate([[0], np.cumsum(head.lengths[i:j])])]
            yield from make(head.ids[i:j], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))

    return assembled(packed, answers(packed, n_parts, answer), assemble, schema)


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, bytes]:
    """The token-byte table: length of each id's bytes, and all bytes one after the other."""
    size = max(ranks.values()) + 1 if ranks else 0
    table = [b""] * size
    for token, rank in ranks.items():
        table[rank] = token
    return np.fromiter(map(len, table), np.int64, size), b"".join(table)


class TokenBytes:
    """The token-byte table as arrays indexed by id; ids join it in numpy."""

    def __init__(self, length: np.ndarray, body: bytes):
        self.length, self.body = length, np.frombuffer(body, np.uint8)
        self.start = np.cumsum(length) - length

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each id list of an array; a null list gives none."""
        ends = np.asarray(lists.offsets)
        ids = np.asarray(lists.values)[ends[0]:ends[-1]] if len(lists) else np.empty(0, np.int32)
        lengths = self.length[ids]
        out = self.body[gather(self.start[ids], lengths)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(lengths)])[ends - ends[0]].tolist() if len(lists) else [0]
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]


def _pieces(b: pa.RecordBatch, most: int = 1_000_000):
    """Row slices of at most about ``most`` ids (column 1 holds the lists)."""
    ends, i = np.asarray(b.column(1).offsets), 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield b.slice(i, j - i)
        i = j


def decode(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids`` -> the same with ``decoded``, the bytes of the ids: a join with the token-byte table.

    The table has a row for each token of the vocabulary, whose size doesn't depend on the data; it is broadcast and
    joined by id inside Arrow batches.  A null array decodes to no bytes.
    """
    shared = spark.sparkContext.broadcast(token_table(ranks))

    def rows(it):
        table = TokenBytes(*shared.value)
        for b in it:
            for s in _pieces(b):
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(table.decode(s.column(1)), pa.binary())],
                                                 ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, DECODED)


def encode_digest(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, **columns) -> DataFrame:
    """Encode all documents, decode the ids again, and return the digests of both: ``doc_id, n_tokens, ids_sha256
    (of the ids as little-endian unsigned 32-bit integers), decoded_sha256``."""
    shared = spark.sparkContext.broadcast(token_table(ranks))

    def rows(ids, lists):
        decoded = TokenBytes(*shared.value).decode(lists)
        ends, values = np.asarray(lists.offsets).tolist(), np.asarray(lists.values).astype("<u4")
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([j - i for i, j in zip(ends, ends[1:])], pa.int64()),
            pa.array([hashlib.sha256(values[i:j].tobytes()).hexdigest() for i, j in zip(ends, ends[1:])]),
            pa.array([hashlib.sha256(d).hexdigest() for d in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(spark, docs, ranks, pattern, rows=rows, schema=DIGEST, **columns)
