"""Vectorised word hashing over Arrow string columns.

The operators that compare word sequences (2, 3, 6, 8) never build Python word
objects: an Arrow string column is one UTF-8 buffer plus offsets, and words,
their 64-bit hashes and their document boundaries come out of a handful of
numpy passes over that buffer, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one go; bounds the temporary arrays of a task.
SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MULT = _U(0xD6E8FEB86659FD93)

# One fixed pseudo-random 64-bit value for each byte.
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(
    0, 1 << 64, 256, dtype=np.uint64, endpoint=False) | _U(1)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes end a word, and the hash value of every other byte."""

    separator: np.ndarray
    value: np.ndarray


def _alphabet(separators: bytes, fold_case: bool) -> Alphabet:
    sep = np.zeros(256, dtype=bool)
    sep[list(separators)] = True
    fold = np.arange(256)
    if fold_case:
        fold[65:91] += 32
    return Alphabet(sep, _BYTE_VALUE[fold])


_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
SPACE_FOLDED = _alphabet(_SPACE, True)
#: ``[^\x20\x09-\x0D]+`` unchanged.
SPACE_EXACT = _alphabet(_SPACE, False)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z (A-Z are word bytes then).
ALNUM_FOLDED = _alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                                *range(0x7B, 0x80)]), True)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i (mod 2^64) for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of consecutive documents: ``hash[first[d]:first[d + 1]]`` are those of document d;
    ``start``/``end`` are byte positions in ``data``."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of the documents ``data[offsets[d]:offsets[d + 1]]``; a word never spans documents."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    sep = alphabet.separator[data]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = sep[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = sep[1:]
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~sep
    start = np.flatnonzero(word & begins)
    end = np.flatnonzero(word & ends) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(alphabet.value[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * _MULT))
    return Words(h, np.searchsorted(start, offsets), start, end, data)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents (first, last + 1, bytes, offsets) of about ``limit`` bytes; every document whole."""
    data, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def ngrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one document, and the position of their first word."""
    h = words.hash
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _MULT
        acc += h[j:j + n]
    # the last word of a document starts no k-gram that leaves it
    limit = np.repeat(words.first[1:], np.diff(words.first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= limit)
    return mix(acc[at] ^ _U(k)), at
