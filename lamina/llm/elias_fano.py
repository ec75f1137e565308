"""Elias-Fano levels of an n-gram trie, searched for whole arrays at once."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_U = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)  # place of the k-th one of a byte
for _b in range(256):
    for _k, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _p


class EliasFano:
    """A sorted array of n integers below ``universe``.

    The low bits of a value are stored as they are; the high bits in unary: one
    1 for each value, one 0 for each step of the high part.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(_U)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        steps = (universe >> self.low_bits) + 2
        bits = np.zeros(-(-(n + steps) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.unary = np.packbits(bits, bitorder="little")
        wide = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= self.low_bits)
        self.low = (values & _U((1 << self.low_bits) - 1)).astype(wide)
        ones = _ONES[self.unary].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.zeros_before = np.concatenate([[0], np.cumsum(64 - ones)])
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])

    def arrays(self) -> list[str]:
        return ["unary", "low", "zeros_before", "ones_before"]

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Bit place of the k-th one (or zero, with ``flip`` 255)."""
        word = np.searchsorted(before, k, side="right") - 1
        left, place = k - before[word], word * 64
        at, done = word * 8, np.zeros(len(k), bool)
        for _ in range(8):
            count = _ONES[self.unary[np.minimum(at, len(self.unary) - 1)] ^ flip]
            stay = done | (left < count)
            left = np.where(stay, left, left - count)
            place = np.where(stay, place, place + 8)
            at = np.where(stay, at, at + 1)
            done = stay
        return place + _SELECT[self.unary[at] ^ flip, left]

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones_before, 0) - i).astype(_U)
        return (high << _U(self.low_bits)) | self.low[i].astype(_U)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1: the bucket of its high part, then the low parts.

        Where ``begin`` and ``stop`` are given, x is sought in that run only.
        """
        if not self.n or not len(x):
            return np.full(len(x), -1)
        x = x.astype(_U)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        low = (x & _U((1 << self.low_bits) - 1)).astype(self.low.dtype)
        end = self._select(high, self.zeros_before, 255) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros_before, 255) - np.maximum(high - 1, 0), 0)
        if begin is not None:
            start, end = np.maximum(start, begin), np.minimum(end, stop)
        found = np.full(len(x), -1)
        while True:  # binary search in the buckets that hold more
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                return found
            middle = (start[open_] + end[open_]) // 2
            here, want = self.low[middle], low[open_]
            hit = here == want
            found[open_[hit]] = middle[hit]
            start[open_] = np.where(here < want, middle + 1, start[open_])
            end[open_] = np.where(hit, start[open_], np.where(here > want, middle, end[open_]))


class Trie:
    """Two levels: contexts, and under each its successors with a coded value.

    Contexts are a monotone sequence, as are the pointers, which say where each
    context's run begins.  Successors are stored relative to their context's rank,
    so the level is monotone too; a successor is sought in its context's run.  All arrays are mapped from a
    file, so the pages in use and no more are in memory.
    """

    def __init__(self, contexts: np.ndarray, of: np.ndarray, successors: np.ndarray, bits: int, values: np.ndarray, levels: int = 255):
        self.contexts, self.bits = EliasFano(contexts, 1 << 64), bits
        self.pointers = EliasFano(np.searchsorted(of, np.arange(len(contexts) + 1)), len(of) + 1)
        self.level = EliasFano((of.astype(_U) << _U(bits)) | successors, max(1, len(contexts)) << bits)
        self.floor = float(values.min()) if len(values) else 0.0
        self.step = (float(values.max()) - self.floor) / (levels - 1) or 1.0 if len(values) else 1.0
        self.codes = (np.round((values - self.floor) / self.step) + 1).astype(np.uint8)

    def map_to(self, folder: str | None = None) -> Trie:
        """Move every array into one file and map it; the file goes with the map."""
        owners = [(o, name) for o in (self.contexts, self.pointers, self.level) for name in o.arrays()] + [(self, "codes")]
        fd, path = tempfile.mkstemp(dir=folder)
        try:
            places = []
            with os.fdopen(fd, "wb") as f:
                for owner, name in owners:
                    a = np.ascontiguousarray(getattr(owner, name))
                    f.write(bytes(-f.tell() % 8))
                    places.append((f.tell(), a.dtype, len(a)))
                    f.write(a.tobytes())
            for (owner, name), (at, dtype, n) in zip(owners, places, strict=True):
                setattr(owner, name, np.memmap(path, dtype, "r", at, (n,)) if n else np.zeros(0, dtype))
        finally:
            os.unlink(path)
        return self

    def look_up(self, contexts: np.ndarray, which: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each (contexts[which], successor); 0 where the trie has none."""
        rank = self.contexts.find(contexts)
        known = np.maximum(rank, 0)
        begin, stop = (self.pointers.get(known + i).astype(np.int64) if self.contexts.n else known for i in (0, 1))
        stop = np.where(rank >= 0, stop, begin)  # an unknown context has an empty run
        where = self.level.find((known[which].astype(_U) << _U(self.bits)) | successors, begin[which], stop[which])
        out = np.zeros(len(which), np.uint8)
        out[where >= 0] = self.codes[where[where >= 0]]
        return out

    def children(self, context: int) -> np.ndarray:
        """Successors of the context of that rank, by its pointers."""
        start, end = self.pointers.get(np.array([context, context + 1])).astype(np.int64)
        return self.level.get(np.arange(start, end)) & _U((1 << self.bits) - 1)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.floor + (codes.astype(np.float64) - 1) * self.step
