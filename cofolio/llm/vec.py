"""Whole batches of texts as numpy arrays: bytes, words and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together (one longer text is a piece of its own).
PIECE = (1 << 20) - 2
#: Powers that a worker keeps; longer series, for longer texts, are made when they are needed.
_KEPT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and the offsets (one more than texts)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(2)
def _kept(base: int) -> np.ndarray:
    return _series(base, _KEPT)


def _power(base: int, n: int) -> np.ndarray:
    return _kept(base)[:n] if n <= _KEPT else _series(base, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse."""
    return _power(_BASE, n), _power(_INVERSE, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with one place more than data; a stretch [i, j) hashes to (H[j] - H[i]) * inverse^i."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = out[1:]
    terms[:] = data
    terms += np.uint64(1)
    terms *= _power(_BASE, len(data))
    np.cumsum(terms, out=terms)
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII white space, within a text), and the number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_BLANK[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[0], last[-1] = True, True
    first[1:] = ~ink[:-1]
    last[:-1] = ~ink[1:]
    first[inner] = True
    last[inner - 1] = True
    starts, ends = np.flatnonzero(ink & first), np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = prefix_hash(data)
    return mix((h[ends] - h[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
