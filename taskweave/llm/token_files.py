"""Token ids of a corpus as binary shard files with keyed access.

A shard file holds the raw ids of its documents, one after the other in ascending doc_id order, and an index: a minimal
perfect hash maps a document's key to its slot, and the slot holds a fingerprint of the key, the number of its first
document in the shard and how many documents share the key.  Looking up a key costs the same however large the shard is.

Layout: magic, payload (ids as little-endian unsigned integers of 2 or 4 bytes), sections, footer (JSON: counts and
each section's place and type), length of the footer (8 bytes), magic.  Sections: ``ends`` (running number of ids after
each document), ``widths``, ``bits``, ``ranks`` (the hash), ``prints``, ``firsts``, ``same`` (by slot).
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, stored
from .perfect_hash import PerfectHash, fingerprints

MAGIC = b"TWSHARD1"
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_null long, first_id long, last_id long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Texts between which a missing piece is encoded together with others, and pieces in each such text.
PIECES = 1000
#: Pieces in each of the two generations of a Python worker's cache.
CACHE = 800_000
#: How a single line break is cut off as the beginning of a piece (no text holds a lone surrogate).
NEWLINE = " \udc0a"
#: Documents are read in blocks of about so many bytes.
READ_BYTES = 4 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to, so that executors open the same place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PieceEncoder:
    """Texts -> raw ids by a byte-level BPE of the tokenizers library, each distinct piece of a task once.

    A text is cut before single spaces, where byte-level pre-tokenizers always begin a new word (see
    ``byte_bpe.word_splitter``).  Missing pieces without other white space are encoded many to a text and cut again where
    a token begins with a space.  Where no white space stands beside other white space, texts are cut before line breaks too,
    which are pre-tokens of their own there.  Texts with a space inside a run of white space, and those that hold the string of an
    added (special) token, are encoded as a whole.  Pieces are kept in two generations: a full one becomes the old one,
    from which pieces come back when they are seen again, so frequent pieces stay.
    """

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        size = max([end_id, *vocabulary.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.starts = np.zeros(size, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.end = np.array([end_id], self.dtype).tobytes()
        self.inside, self.double = re.compile(r"\s (?:\s|\Z)").search, re.compile(r"\s\s").search
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        is_plain = [p.split() == [p] and p[0] != NEWLINE[1] for p in missing]  # neither empty nor with white space
        plain = [p for p, yes in zip(missing, is_plain) if yes]
        for at in range(0, len(plain), PIECES * 32):
            some = plain[at:at + PIECES * 32]
            groups = [some[i:i + PIECES] for i in range(0, len(some), PIECES)]
            for group, ids in zip(groups, self._encode([" " + " ".join(g) for g in groups])):
                cuts = np.append(np.flatnonzero(self.starts[ids]), len(ids)) * self.dtype.itemsize
                raw, cuts = ids.tobytes(), cuts.tolist()
                self.pieces.update(zip(group, [raw[i:j] for i, j in zip(cuts, cuts[1:])], strict=True))
        odd = [p for p, yes in zip(missing, is_plain) if not yes]
        whole = ["\n" + p[1:] if p[:1] == NEWLINE[1] else " " + p for p in odd]
        self.pieces.update(zip(odd, [x.tobytes() for x in self._encode(whole)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The raw ids of each text, the end id included."""
        split = [None if self.inside(t) or any(a in t for a in self.added)
                 else (t if "\n" not in t or self.double(t) else t.replace("\n", NEWLINE)).split(" ") for t in texts]
        if len(self.pieces) > CACHE:
            self.pieces, self.old = {}, self.pieces
        pieces, old = self.pieces, self.old
        found = [None if s is None else list(map(pieces.get, s)) for s in split]
        holes = [(s, f, [i for i, x in enumerate(f) if x is None]) for s, f in zip(split, found) if f and None in f[1:]]
        unseen = {s[i] for s, _, at in holes for i in at if i}
        pieces.update([(p, old[p]) for p in unseen if p in old])
        self._learn([p for p in unseen if p not in old])
        for s, f, at in holes:
            for i in at:
                f[i] = pieces.get(s[i])
        out = []
        for f, ids in zip(found, self._encode([t if s is None else s[0] for t, s in zip(texts, split)])):
            parts = f or [b""]
            parts[0] = ids.tobytes()  # no space stands before a first piece
            out.append(b"".join(parts) + self.end)
        return out


class ShardWriter:
    """Writes one shard under a name of its own and moves it into place when it is whole."""

    def __init__(self, path: str, dtype: np.dtype, end_id: int):
        self.fs, self.path = file_system(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.dtype, self.end_id = dtype, end_id
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.keys.append(key)
        self.sizes.append(len(raw) // self.dtype.itemsize)

    def close(self) -> dict:
        ends = np.cumsum(self.sizes, dtype=np.int64)
        n_null = sum(k is None for k in self.keys)
        keys, firsts, same = np.unique(np.array(self.keys[n_null:], np.int64), return_index=True, return_counts=True)
        index = PerfectHash.build(keys)
        slots = index.slots(keys)
        by_slot = np.argsort(slots)
        sections = {"ends": ends, "widths": index.widths, "bits": index.bits, "ranks": index.ranks, "prints": fingerprints(keys[by_slot]),
                    "firsts": firsts[by_slot].astype(np.int64) + n_null, "same": same[by_slot].astype(np.int64)}
        at = len(MAGIC) + int(ends[-1] if len(ends) else 0) * self.dtype.itemsize
        footer = {"ids": self.dtype.str, "end_id": self.end_id, "n_docs": len(self.keys), "n_ids": int(ends[-1]) if len(ends) else 0,
                  "n_null": n_null, "n_keys": len(keys), "sections": {}}
        for name, a in sections.items():
            raw = np.ascontiguousarray(a).tobytes()
            footer["sections"][name] = [at, len(raw), a.dtype.str]
            self.out.write(raw)
            at += len(raw)
        tail = json.dumps(footer).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return footer


class ShardReader:
    """Keyed access to a shard file."""

    def __init__(self, path: str):
        files, local = file_system(path)
        self.file = files.open_input_file(local)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a whole shard file")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.file.read_at(n, size - 8 - len(MAGIC) - n))
        part = {name: np.frombuffer(self.file.read_at(length, at), dtype) for name, (at, length, dtype) in self.footer["sections"].items()}
        self.ends, self.prints, self.firsts, self.same = part["ends"], part["prints"], part["firsts"], part["same"]
        self.index = PerfectHash(part["widths"], part["bits"], part["ranks"])
        self.dtype = np.dtype(self.footer["ids"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``keys``, document number in the shard) of every document of the keys that the shard holds."""
        slots = self.index.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        which = np.flatnonzero(known)
        first, same = self.firsts[slots[which]], self.same[slots[which]]
        ends = np.cumsum(same)
        return np.repeat(which, same), np.repeat(first - (ends - same), same) + np.arange(ends[-1] if len(ends) else 0)

    def read(self, numbers: np.ndarray):
        """(document number, first id, ids) of documents in ascending order, read in blocks."""
        size = self.dtype.itemsize
        begin, end = np.where(numbers > 0, self.ends[numbers - 1], 0), self.ends[numbers]
        i = 0
        while i < len(numbers):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + READ_BYTES // size, side="right")))
            block = np.frombuffer(self.file.read_at(int(end[j - 1] - begin[i]) * size, len(MAGIC) + int(begin[i]) * size), self.dtype)
            for d, a, b in zip(numbers[i:j].tolist(), begin[i:j].tolist(), end[i:j].tolist()):
                yield d, a, block[a - int(begin[i]):b - int(begin[i])]
            i = j


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents and write shard files under ``folder``; returns the stored manifest, a row for each shard.

    Documents are dealt by range on (doc_id, text hash, place in the input), so shards are even even if one doc_id or one
    whole row repeats very often, sorted within each shard and streamed into its file; shards in order hold the documents in ascending doc_id order, nulls first.
    A task that runs again writes the same file again.  A null text counts as empty (only the end id).  Empty tables
    give an empty manifest.
    """
    folder = qualified(spark, folder or fresh_dir(spark, "token-shards"))
    files, local = file_system(folder)
    files.create_dir(local, recursive=True)
    with open(tokenizer_path, encoding="utf-8") as f:
        # a worker keeps the value of a broadcast for its later tasks, and with it the encoder and its cache
        shared = spark.sparkContext.broadcast({"tokenizer": f.read()})

    def write(it):
        writer = encoder = None
        number, first = TaskContext.get().partitionId(), None
        for b in it:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                ids = s.column(0).to_pylist()
                if writer is None:
                    encoder = shared.value.get("encoder") or PieceEncoder(shared.value["tokenizer"], end_id)
                    shared.value["encoder"] = encoder
                    path = f"{folder}/shard-{number:06d}.ids"
                    writer = ShardWriter(path, encoder.dtype, end_id)
                for i, raw in zip(ids, encoder.encode([t or "" for t in s.column(1).to_pylist()])):
                    writer.add(i, raw)
                    first = i if first is None else first
        if writer:
            footer = writer.close()
            row = (number, path, footer["n_docs"], footer["n_ids"], footer["n_null"], first, writer.keys[-1])
            types = (pa.int32(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in MANIFEST.split(", ")])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                         F.monotonically_increasing_id().alias("at"))
    order = ["doc_id", "tie", "at"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(spark, ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up documents by key: ``doc_id, start, n_tokens, ids_crc32`` for all documents of the distinct ``keys`` (one
    column of longs).  ``start`` is the number of ids before the document in all shards, ``ids_crc32`` the unsigned CRC-32
    of its ids as little-endian unsigned 32-bit integers.  Unknown keys give no row; a null key finds the documents with
    a null id.  The manifest is on the driver, a row for each shard.
    """
    shards = [r.asDict() for r in manifest.orderBy("shard").collect()]
    bases = np.cumsum([0, *(s["n_ids"] for s in shards)]).tolist()
    sure = [i for i, s in enumerate(shards) if s["last_id"] is not None]
    last = np.array([shards[i]["last_id"] for i in sure], np.int64)
    least = np.array([np.iinfo(np.int64).min if shards[i]["first_id"] is None else shards[i]["first_id"] for i in sure], np.int64)
    nulls = [i for i, s in enumerate(shards) if s["n_null"]]

    def route(it):
        for b in it:
            column = b.column(0)
            own = np.asarray(column.drop_null())
            low, high = np.searchsorted(last, own, "left"), np.maximum(np.searchsorted(least, own, "right"), 0)
            many = np.maximum(high - low, 0)
            to = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sure, np.int32)[to] if len(to) else np.empty(0, np.int32)),
                                              pa.array(np.repeat(own, many))], ["shard", "key"])
            if column.null_count:
                yield pa.RecordBatch.from_arrays([pa.array(nulls, pa.int32()), pa.nulls(len(nulls), pa.int64())], ["shard", "key"])

    def look_up(it):
        reader = at = None
        for b in it:
            numbers = np.asarray(b.column(0))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]]).tolist()
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if numbers[i] != at:
                    at = int(numbers[i])
                    reader = ShardReader(shards[at]["path"])
                column = b.column(1).slice(i, j - i)
                keys = np.asarray(column.drop_null())
                which, docs = reader.find(keys)
                ids = dict(zip(docs.tolist(), keys[which].tolist()))
                if column.null_count:
                    ids.update((d, None) for d in range(reader.footer["n_null"]))
                out = [(ids[d], bases[at] + start, len(raw), zlib.crc32(raw.astype("<u4").tobytes()))
                       for d, start, raw in reader.read(np.array(sorted(ids), np.int64))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in RECORDS.split(", ")])

    routed = keys.distinct().mapInArrow(route, "shard int, key long")
    return routed.repartition(max(len(shards), 1), "shard").sortWithinPartitions("shard").mapInArrow(look_up, RECORDS)
