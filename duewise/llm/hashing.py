"""Vectorised 64-bit hashes of words and word windows of one text.

A word's hash is a polynomial over random values of its bytes, finished by a mixer; a window's hash is a
polynomial over its words' hashes, again mixed. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

#: White space of ASCII, the separators of the word definition ``[^\\x20\\x09-\\x0D]+``.
SPACES = b"\t\n\x0b\x0c\r "

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_TABLE = _powers(_P, 1 << 12)
_PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that close inputs give unrelated outputs."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of the text."""
    starts, ends = word_spans(data)
    if len(data) > _PIECE:
        # A very long text goes through in pieces of whole words, so that working memory stays small.
        cuts = np.flatnonzero(np.diff(starts // _PIECE)) + 1
        parts = [_hashes_at(data, a, b) for a, b in zip(np.split(starts, cuts), np.split(ends, cuts), strict=True)]
        return np.concatenate(parts)
    return _hashes_at(data, starts, ends)


def _hashes_at(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    table = _TABLE if lengths.max() <= len(_TABLE) else _powers(_P, int(lengths.max()))
    total = int(lengths.sum())
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    inside = np.arange(total) - np.repeat(first, lengths)
    letters = np.frombuffer(data, np.uint8)[np.repeat(starts, lengths) + inside]
    return mix(np.add.reduceat(_BYTE_VALUES[letters] * table[inside], first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` consecutive words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= _Q
        out += words[j : n + j]
    return mix(out)


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words ``[start, end)`` for each pair; the lengths may differ."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _powers(_Q, int(lengths.max()))
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = words[np.repeat(starts, lengths) + inside] * powers[inside]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
