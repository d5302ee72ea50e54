"""Minimal perfect hash of distinct 64-bit keys, with fingerprints that reject foreign keys (numpy)."""

from __future__ import annotations

import numpy as np

GAMMA, BLOCK = 2.0, 512


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each key, one to one for each salt."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((salt + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bit arrays: a key lives in the first level where its bit is set; its slot is that bit's rank.

    ``widths``: bits of each level; ``bits``: all levels' bits, packed; ``ranks``: set bits before each block of 512.
    """

    def __init__(self, widths: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.widths, self.bits, self.ranks = widths, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct int64."""
        widths, parts = [], []
        while len(keys):
            width = -(-int(GAMMA * len(keys)) // BLOCK) * BLOCK or BLOCK
            at = (mix(keys, len(widths)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            widths.append(width)
            parts.append(np.packbits(alone))
            keys = keys[~alone[at]]
        bits = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        counts = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1) if len(bits) else np.empty(0, np.int64)
        return cls(np.array(widths, np.int64), bits, (np.cumsum(counts) - counts).astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that find no bit.  A foreign key may get a slot: compare fingerprints."""
        out = np.full(len(keys), -1, np.int64)
        left, before = np.arange(len(keys)), 0
        for level, width in enumerate(self.widths.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level) % np.uint64(width)).astype(np.int64) + before
            hit = (self.bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            out[left[hit]] = self._rank(at[hit])
            left, before = left[~hit], before + width
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // BLOCK
        rows = self.bits.reshape(-1, BLOCK // 8)[block].copy()
        inside = at % BLOCK
        whole = np.arange(BLOCK // 8)[None, :]
        byte = (inside >> 3)[:, None]
        rows[whole > byte] = 0
        last = np.take_along_axis(rows, byte, axis=1)[:, 0]
        kept = last & (0xFF00 >> (inside & 7)).astype(np.uint8)  # the bits before this one
        np.put_along_axis(rows, byte, kept[:, None], axis=1)
        return self.ranks[block] + np.bitwise_count(rows).sum(axis=1)
