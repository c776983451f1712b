"""Elias-Fano sequences and a two-level n-gram trie over them, in memory-mapped files.

Everything works on whole arrays of queries at a time.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONE = np.uint64(1)
_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th one (or zero) bit of a byte.
_PLACE = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _PLACE[_b, _k] = _p


class EliasFano:
    """An ascending sequence of n whole numbers below ``universe``, about 2 + log2(universe / n) bits each.

    ``upper`` holds the high parts in unary (byte array), ``ones`` the number of ones before each byte,
    ``lower`` the packed low parts.
    """

    def __init__(self, n: int, bits: int, upper: np.ndarray, ones: np.ndarray, lower: np.ndarray):
        self.n, self.bits, self.upper, self.ones, self.lower = n, bits, upper, ones, lower

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        bits = max(0, (max(1, int(universe)) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(bits)).astype(np.int64)
        place = high + np.arange(n)
        size = (int(universe) >> bits) + n + 2
        upper = np.packbits(np.bincount(place, minlength=size).astype(np.uint8)[:size] if n else np.zeros(size, np.uint8), bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_BYTE_ONES[upper], dtype=np.int64)])
        words = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            low = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return bits, upper, ones, words

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.lower[word] >> shift
        over = shift + np.uint64(self.bits) > 64
        out[over] |= self.lower[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the i-th one or zero of the unary part."""
        before = self.ones if ones else np.arange(len(self.ones)) * 8 - self.ones
        byte = np.searchsorted(before, i, "right") - 1
        value = self.upper[byte]
        return byte * 8 + _PLACE[value if ones else ~value, i - before[byte]]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.bits) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element that isn't below x (n where there is none); given ``first`` and ``last``, within those bounds."""
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        zeros = int(len(self.ones) - 1) * 8 - int(self.ones[-1])
        beyond = high >= zeros - 1
        high = np.minimum(high, zeros - 2)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        end = self._select(high, False) - high
        if first is not None:
            begin, end = np.clip(begin, first, last), np.clip(end, first, last)
        at, low = begin.astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        span = int((end - begin).max(initial=0))
        if self.bits:
            # halve the stretch of equal high parts
            lo, hi = begin.copy(), end.copy()
            for _ in range(span.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                less = self._low(mid) < low[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            at = lo
        return np.where(beyond, self.n, at)


class Mapped:
    """Arrays written to a file of the task and mapped from it; the file is gone when this is closed."""

    def __init__(self) -> None:
        handle, self.path = tempfile.mkstemp(suffix=".trie")
        self.file = os.fdopen(handle, "wb")
        self.parts: list[tuple[int, np.dtype, int]] = []

    def add(self, a: np.ndarray) -> int:
        self.file.write(b"\0" * (-self.file.tell() % 8))
        self.parts.append((self.file.tell(), a.dtype, len(a)))
        self.file.write(np.ascontiguousarray(a).tobytes())
        return len(self.parts) - 1

    def map(self) -> list[np.ndarray]:
        self.file.close()
        return [np.memmap(self.path, kind, "r", at, (n,)) if n else np.zeros(0, kind) for at, kind, n in self.parts]

    def close(self) -> None:
        os.unlink(self.path)


class BigramTrie:
    """Contexts, pointers to their successors, successors, and quantised probabilities of both.

    The successors of all contexts are one ascending sequence: the i-th context's successor w is i * width + w,
    so a search for it is relative to its context. ``pointers`` bound each context's successors.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray, width: int, seen: np.ndarray, mass: np.ndarray):
        """``contexts`` ascending, each with ``counts`` successors in ``words`` (ascending in a context);
        ``seen`` and ``mass`` are quantised values of successors and contexts."""
        self.width, self.file = np.uint64(width), Mapped()
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        of = np.repeat(np.arange(len(contexts), dtype=np.uint64), counts)
        layout = []
        for values, universe in ((contexts, int(contexts[-1]) + 1 if len(contexts) else 1), (pointers, len(words) + 1), (of * self.width + words, max(1, len(contexts)) * width)):
            bits, *arrays = EliasFano.arrays(values, universe)
            layout.append((len(values), bits, [self.file.add(a) for a in arrays]))
        codes = [self.file.add(seen), self.file.add(mass)]
        parts = self.file.map()
        self.contexts, self.pointers, self.words = (EliasFano(n, bits, *(parts[k] for k in ks)) for n, bits, ks in layout)
        self.seen, self.mass = (parts[k] for k in codes)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised values of (context, word) and of the context; 0 where the trie lacks it."""
        seen, mass = np.zeros(len(word), np.uint16), np.zeros(len(word), np.uint16)
        if not self.contexts.n:
            return seen, mass
        at = self.contexts.successor(context)
        has = at < self.contexts.n
        has[has] = self.contexts[at[has]] == context[has]
        mass[has] = self.mass[at[has]]
        hit = np.flatnonzero(has & (word < self.width))
        node = at[hit]
        target = node.astype(np.uint64) * self.width + word[hit]
        first, last = (self.pointers[k].astype(np.int64) for k in (node, node + 1))
        place = self.words.successor(target, first, last)
        inside = place < last
        hit, target, place = hit[inside], target[inside], place[inside]
        equal = self.words[place] == target
        seen[hit[equal]] = self.seen[place[equal]]
        return seen, mass

    def close(self) -> None:
        self.file.close()
