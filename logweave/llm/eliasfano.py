"""Elias-Fano coded levels of an n-gram trie, in numpy over memory-mapped bytes."""

from __future__ import annotations

import mmap

import numpy as np

#: Entries that are decoded at once.
BLOCK = 4096


def mapped(array: np.ndarray) -> np.ndarray:
    """A copy of the array in a memory map of its own, which belongs to no heap and no file."""
    data = np.ascontiguousarray(array)
    if not data.nbytes:
        return data
    region = mmap.mmap(-1, data.nbytes)
    view = np.frombuffer(region, data.dtype)
    view[:] = data.ravel()
    return view


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest `bits` bits of each value, one after the other."""
    if not bits:
        return np.zeros(0, np.uint8)
    parts = []
    for a in range(0, len(values), BLOCK):
        octets = values[a : a + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(octets, axis=1)[:, 64 - bits :].ravel()))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


class EliasFano:
    """A sequence that never falls, of 64-bit numbers: lower bits packed as they are, the rest in
    unary. A directory has, for each block of BLOCK entries, where its unary part begins."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        self.low = mapped(_pack(values, self.bits))
        highs = (values >> np.uint64(self.bits)).astype(np.int64)
        ones = highs + np.arange(self.n)
        unary = np.zeros((int(ones[-1]) + 1 if self.n else 0), np.uint8)
        unary[ones] = 1
        self.high = mapped(np.packbits(unary))
        self.begins = mapped(ones[::BLOCK])
        self.firsts = mapped(values[::BLOCK])

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.begins.nbytes + self.firsts.nbytes

    def block(self, b: int) -> np.ndarray:
        """The entries of one block."""
        count = min(BLOCK, self.n - b * BLOCK)
        start = int(self.begins[b])
        stop = int(self.begins[b + 1]) if b + 1 < len(self.begins) else len(self.high) * 8
        byte = start >> 3
        unary = np.unpackbits(self.high[byte : (stop + 7) >> 3])
        ones = np.flatnonzero(unary[start - 8 * byte :])[:count] + start
        highs = (ones - np.arange(b * BLOCK, b * BLOCK + count)).astype(np.uint64)
        if not self.bits:
            return highs
        size = BLOCK * self.bits // 8  # whole bytes, as a block holds a multiple of eight entries
        packed = np.unpackbits(self.low[b * size : (b + 1) * size])[: count * self.bits].reshape(count, self.bits)
        padded = np.zeros((count, 64), np.uint8)
        padded[:, 64 - self.bits :] = packed
        lows = np.packbits(padded, axis=1).view(">u8").ravel().astype(np.uint64)
        return highs << np.uint64(self.bits) | lows

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.begins))]) if self.n else np.zeros(0, np.uint64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The entries at places in rising order. Only blocks with such places are decoded, each once."""
        out = np.empty(len(places), np.int64)
        home = places // BLOCK
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(home)) + 1, [len(places)])) if len(places) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            out[a:z] = self.block(int(home[a]))[places[a:z] - int(home[a]) * BLOCK].astype(np.int64)
        return out

    def successors(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For numbers in rising order: the place of the first entry that is not smaller, and whether
        it is equal. Only blocks that numbers fall into are decoded, each once."""
        place, equal = np.full(len(sought), self.n, np.int64), np.zeros(len(sought), bool)
        if not self.n or not len(sought):
            return place, equal
        home = np.maximum(np.searchsorted(self.firsts, sought, side="left") - 1, 0)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(home)) + 1, [len(sought)]))
        for a, z in zip(cuts[:-1], cuts[1:]):
            b = int(home[a])
            entries = self.block(b)
            at = np.searchsorted(entries, sought[a:z])
            inside = at < len(entries)
            place[a:z] = b * BLOCK + at
            equal[a:z][inside] = entries[at[inside]] == sought[a:z][inside]
            if not inside.all() and b + 1 < len(self.firsts):  # the successor begins the next block
                over = np.flatnonzero(~inside) + a
                equal[over] = self.firsts[b + 1] == sought[over]
        return place, equal
