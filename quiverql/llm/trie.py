"""Pieces looked up by their bytes, at many places at once."""

from __future__ import annotations

import numpy as np


class Trie:
    """Pieces by their bytes; a step from many nodes at once is a probe of one hash table."""

    BITS, MULTIPLIER, END = 19, np.uint64(0x9E3779B97F4A7C15), 256

    def __init__(self, pieces: list[bytes]):
        nodes, ends = {b"": 0}, {}
        for i, piece in enumerate(pieces):
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
            ends[nodes[piece]] = i
        self.piece = np.full(len(nodes), -1, dtype=np.int32)
        self.piece[list(ends.keys())] = list(ends.values())
        bits = max(self.BITS, (4 * len(nodes)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.child = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        prefixes = [p for p in nodes if p]
        key = np.array([nodes[p[:-1]] << 9 | p[-1] for p in prefixes], dtype=np.uint64)
        child = np.array([nodes[p] for p in prefixes], dtype=np.int32)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):  # of those that want one free slot the first gets it, the others go on to the next
            free = left[self.child[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.child[slot[won]] = key[won], child[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) % size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * self.MULTIPLIER >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that each byte leads to, -1 where no piece goes on with it."""
        key = node.astype(np.uint64) << np.uint64(9) | byte.astype(np.uint64)
        slot = self._slot(key)
        child = self.child[slot]
        open_ = np.flatnonzero((child >= 0) & (self.keys[slot] != key))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.child)
            child[open_] = self.child[slot[open_]]
            open_ = open_[(child[open_] >= 0) & (self.keys[slot[open_]] != key[open_])]
        return child


def laid_out(data: np.ndarray, begin: np.ndarray, length: np.ndarray, lead: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words one after the other, each with ``lead`` before it (if given) and the end mark after it, and where they begin."""
    extra = 1 + (lead is not None)
    size = length + extra
    head = np.cumsum(size) - size
    flat = np.full(int(size.sum()), Trie.END, dtype=np.int32)
    if lead is not None:
        flat[head] = lead
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    flat[at + np.repeat(head + extra - 1, length)] = data[at + np.repeat(begin, length)]
    return flat, head
