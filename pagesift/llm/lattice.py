"""Piece lattices of many words at once: all substrings of words of one length, looked up in a hash table of pieces."""

from collections import defaultdict

import numpy as np

from pagesift.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)


class PieceTable:
    """Indexes of pieces by their code points; open addressing over 64-bit hashes."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        bits = max(10, int(len(pieces) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.index = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        by_size = defaultdict(list)
        for i, p in enumerate(pieces):
            by_size[len(p)].append(i)
        for size, which in by_size.items():
            points = letters([pieces[i] for i in which], size)
            h = np.zeros(len(which), np.uint64)
            for k in range(size):
                h = h * _BASE + points[:, k].astype(np.uint64) + np.uint64(1)
            for i, key in zip(which, mixed(h), strict=True):
                slot = int(key >> self.shift)
                while self.index[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.index[slot] = key, i

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key's piece, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.index[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot, want = slot[left], keys[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found = self.index[slot]
            out[left] = found
            more = (found >= 0) & (self.keys[slot] != want)
            left, slot, want = left[more], slot[more], want[more]
        return out

    def edges(self, words: list[str], size: int) -> list[tuple[int, np.ndarray]]:
        """For each piece length n that occurs: n and an array (size - n + 1, words) with the index of the piece at each start, or -1."""
        points = np.ascontiguousarray(letters(words, size).T).astype(np.uint64) + np.uint64(1)
        h, out = np.zeros((size + 1, len(words)), np.uint64), []
        for n in range(1, min(size, self.longest) + 1):
            h = h[:-1] * _BASE + points[n - 1 :]
            found = self.find(mixed(h.ravel())).reshape(h.shape)
            if n == 1 or found.max() >= 0:
                out.append((n, found))
        return out
