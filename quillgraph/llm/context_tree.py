"""Suffix trees of byte contexts, walked for all bytes of a batch at once.

A context of depth d is the d bytes before a byte; as a number its lowest byte
is the nearest one. A gram is a byte and its context: byte + 256 * context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Bytes that are walked at once.
BLOCK = 1 << 19
STOP = b"\n"


def lay_out(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each text): each is preceded by ``depth`` stop bytes and ends with one."""
    gap = STOP * depth
    buffer = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = depth + np.concatenate(([0], np.cumsum(sizes + depth)[:-1])).astype(np.int64) if texts else sizes
    return buffer, starts, starts + sizes + 1


def codes_of(buffer: np.ndarray, low: int, high: int, depth: int) -> np.ndarray:
    """The grams of context depth ``depth`` at the places low to high of a buffer."""
    code = buffer[low:high].astype(np.uint64)
    for d in range(1, depth + 1):
        code |= buffer[low - d : high - d].astype(np.uint64) << np.uint64(8 * d)
    return code


def inside(starts: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which of the places low to high of a buffer belong to a text, its end included."""
    step = np.zeros(high - low + 1, np.int32)
    np.add.at(step, np.clip(starts - low, 0, high - low), 1)
    np.add.at(step, np.clip(ends - low, 0, high - low), -1)
    return np.cumsum(step[:-1]) > 0


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of context depth ``depth`` in texts, their end included, and how often each occurs."""
    buffer, starts, ends = lay_out(texts, depth)
    parts = []
    for low in range(depth, len(buffer), 4 * BLOCK):
        high = min(len(buffer), low + 4 * BLOCK)
        parts.append(np.unique(codes_of(buffer, low, high, depth)[inside(starts, ends, low, high)], return_counts=True))
        if len(parts) > 4:
            parts = [merge_counts(parts)]
    return merge_counts(parts) if len(parts) > 1 else parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of counts from several."""
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


class ContextTree:
    """A set of contexts that holds, with each, all its shorter ones.

    contexts[d]: ascending numbers of those of depth d. Nodes are numbered by
    depth, then number; node 0 is the empty context.
    """

    def __init__(self, contexts: list[np.ndarray]):
        self.contexts = [np.zeros(1, np.uint64), *(np.asarray(c, np.uint64) for c in contexts[1:] if len(c))]
        self.depth = len(self.contexts) - 1
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in self.contexts])))
        self.size = int(self.first[-1])
        self.parent = np.zeros(self.size, np.int64)
        child = np.zeros((self.size, 256), np.uint16 if self.size < 1 << 16 else np.int32)
        for d in range(1, self.depth + 1):
            own = np.arange(self.first[d], self.first[d + 1])
            self.parent[own] = self.number(self.contexts[d] & self._mask(d - 1), d - 1)
            child[self.parent[own], (self.contexts[d] >> np.uint64(8 * (d - 1))).astype(np.int64)] = own
        self.child = child.ravel()
        self.inner = (child > 0).any(axis=1)
        pairs = np.zeros((256, 256), np.int32)  # nearest byte, the one before: the node after two steps
        for near in range(256):
            one = int(child[0, near])
            pairs[near] = np.where(child[one] > 0, child[one], one) if one else 0
        self.pairs = pairs.ravel()

    @staticmethod
    def _mask(depth: int) -> np.uint64:
        return np.uint64((1 << 8 * depth) - 1)

    def number(self, contexts: np.ndarray, depth: int) -> np.ndarray:
        """Node numbers of contexts of one depth, -1 for those that the tree lacks."""
        known = self.contexts[depth]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[at] == contexts, at + self.first[depth], -1)

    def deepest(self, block: np.ndarray, depth: int) -> np.ndarray:
        """The deepest node that fits before each byte of block[depth:]."""
        size = len(block) - depth
        near = block[depth - 1 : depth - 1 + size].astype(np.int32)
        node = self.pairs[(near << 8) | block[depth - 2 : depth - 2 + size]]
        if self.depth > 2:
            alive = np.flatnonzero((node >= self.first[2]) & self.inner[node])
            now = node[alive]
            for d in range(3, self.depth + 1):
                to = self.child[now.astype(np.int64) * 256 + block[alive + (depth - d)]]
                hit = to > 0
                alive, now = alive[hit], to[hit].astype(np.int32)
                node[alive] = now
                go = self.inner[now]
                alive, now = alive[go], now[go]
        return node

    def totals(self, texts: list[bytes], table: np.ndarray, deepen: Callable | None = None, gap: int = 2) -> np.ndarray:
        """Sum over each text's bytes and its end of table[node * 256 + byte], as float64; table: one row or more columns.

        deepen: a function from (nodes, bytes with ``gap`` or more before the first, values) to values of longer contexts.
        """
        depth = max(2, self.depth, gap)
        buffer, starts, ends = lay_out(texts, depth)
        out = np.zeros((len(texts), *table.shape[1:]), np.float64)
        for low in range(depth, len(buffer), BLOCK):
            high = min(len(buffer), low + BLOCK)
            a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            if a >= b:
                continue
            node = self.deepest(buffer[low - depth : high], depth)
            value = table[node.astype(np.int64) * 256 + buffer[low:high]]
            if deepen is not None:
                value = deepen(node, buffer[low - depth : high], value)
            edges = np.clip(np.stack((starts[a:b], ends[a:b]), 1) - low, 0, high - low).ravel()
            value = np.concatenate((value, np.zeros((1, *value.shape[1:]), value.dtype)))
            out[a:b] += np.add.reduceat(value, edges, axis=0, dtype=np.float64)[::2]
        return out


def batches_of(texts: list[bytes], most: int = 1 << 21) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    low = size = 0
    for n, text in enumerate(texts):
        if size and size + len(text) > most:
            yield low, n
            low, size = n, 0
        size += len(text) + 8
    if texts:
        yield low, len(texts)
