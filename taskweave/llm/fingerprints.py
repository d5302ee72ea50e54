"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: bytes, words_each: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words_each`` words (repeats included), or of the whole sequence if it is shorter."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if n <= words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if n else [], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n - words_each + 1].tolist()
    ends = ends[words_each - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[i:j], seed) for i, j in zip(starts, ends)], np.uint64, len(ends))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give 0."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # sums of up to 255 bits fit a byte
        some = hashes[i:i + 255].astype("<u8", copy=False)
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words_each: int = 4, seed: int = SEED) -> int:
    return simhash(shingle_hashes((text or "").encode(), words_each, seed))
