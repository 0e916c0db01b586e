"""Elias-Fano sequences and the n-gram trie built from them (numpy, memory-mapped)."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


#: Ones in each byte, and the place of its r-th one (8 where there is none).
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)
_PLACE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _PLACE[_byte, :_ONES[_byte]] = [i for i in range(8) if _byte >> i & 1]


class EliasFano:
    """A non-decreasing sequence of n numbers below 2^63 in about n * (3 + log2(u / n)) bits.

    The low bits lie packed side by side; the high bits are a unary bit string
    with a directory of the ones before each 64 bits.  All three stay as they
    are mapped: an element is found by selecting its one in the bit string, a
    bucket by selecting the zeros around it.  ``find`` goes to the bucket of a
    number's high bits and halves it by the low bits: constant expected time
    but for the search in the directory.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high.reshape(-1, 8)
        self._ones = ones.view(np.uint32)
        self._zeros = (np.arange(len(self._ones)) * 64 - self._ones).astype(np.uint32)
        self._words = np.ndarray((max(len(low) - 7, 0),), dtype="<u8", buffer=low, strides=(1,)) if len(low) > 7 else None
        self._buckets = int(self._upper(np.array([n - 1]))[0]) + 1 if n else 0

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        """(n, low_bits, low bytes, high bytes, directory bytes) of a non-decreasing uint64 array."""
        n = len(values)
        if not n:
            return 0, 0, np.zeros(8, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        bits = min(56, max(0, (int(values[-1]) // n).bit_length() - 1))
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        chunk = 1 << 16  # a multiple of 8 elements fills whole bytes
        shifts = np.arange(bits, dtype=np.uint64)
        for a in range(0, n if bits else 0, chunk):
            flat = ((values[a:a + chunk, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(flat, bitorder="little")
            low[a * bits // 8:a * bits // 8 + len(packed)] = packed
        upper = (values >> np.uint64(bits)).astype(np.int64)
        # the last bucket ends with a zero of its own; whole words of 64 bits
        marks = np.zeros(-(-(int(upper[-1]) + n + 1) // 64) * 64, np.uint8)
        marks[upper + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little")
        held = _ONES[high].reshape(-1, 8).sum(axis=1)
        return n, bits, low, high, (np.cumsum(held) - held).astype(np.uint32).view(np.uint8)

    def _select(self, r: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the r-th bit of one kind; ``before``: such bits before each word."""
        word = np.searchsorted(before, r.astype(np.uint32), side="right") - 1
        octets = self.high[word] ^ np.uint8(flip)
        upto = np.cumsum(_ONES[octets], axis=1, dtype=np.uint8)
        rest = (r - before[word]).astype(np.int64)
        octet = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(r))
        byte = octets[row, octet]
        rest -= upto[row, octet].astype(np.int64) - _ONES[byte]
        return word * 64 + octet * 8 + _PLACE[byte, rest]

    def _upper(self, i: np.ndarray) -> np.ndarray:
        """High bits of elements."""
        return self._select(i, self._ones, 0) - i

    def _ends(self, bucket: np.ndarray) -> np.ndarray:
        """Number of elements up to and with each bucket (0 for bucket -1)."""
        return np.where(bucket < 0, 0, self._select(np.maximum(bucket, 0), self._zeros, 255) - bucket)

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        return (self._words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.empty(0, np.uint64)
        return (self._upper(i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low_at(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each number, -1 where it is absent."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        ask = np.flatnonzero(top < self._buckets)
        at, end = self._ends(top[ask] - 1), self._ends(top[ask])
        low = x[ask] & np.uint64((1 << self.low_bits) - 1)
        # most buckets have an element or two, full ones are halved
        last, open_ = end.copy(), np.flatnonzero(at < end)
        while len(open_):
            mid = (at[open_] + last[open_]) >> 1
            less = self._low_at(mid) < low[open_]
            at[open_[less]] = mid[less] + 1
            last[open_[~less]] = mid[~less]
            open_ = open_[at[open_] < last[open_]]
        some = np.flatnonzero(at < end)
        hit = some[self._low_at(at[some]) == low[some]]
        out[ask[hit]] = at[hit]
        return out


class Trie:
    """Two levels: words, and for each word the contexts that precede it.

    Level 1 holds sorted word hashes, their counts and quantised log10
    probabilities.  Level 2 holds for each word a run of context numbers (places
    in a sorted context table); runs are made one monotone sequence by adding
    the end of the run before, and monotone pointers say where each begins.
    A context is found relative to its word: base of the run plus its number.
    """

    #: Width of a quantisation step in log10.
    STEP = 1 / 2048

    def __init__(self, blob):
        head = np.frombuffer(blob, np.int64, 32)
        at, parts = 256, []
        for size in head[8:8 + 15]:
            parts.append(np.frombuffer(blob, np.uint8, int(size), at))
            at += int(size) + -int(size) % 8
        ef = [EliasFano(int(head[2 * i]), int(head[2 * i + 1]), *parts[3 * i:3 * i + 3]) for i in range(4)]
        self.words, self.contexts, self.pointers, self.runs = ef
        self.count, self.q1, self.q2 = (parts[12].view(np.int64), parts[13].view(np.int16), parts[14].view(np.int16))

    @classmethod
    def build(cls, word: np.ndarray, context: np.ndarray, count: np.ndarray, log_word, log_pair) -> bytes:
        """Trie of distinct (word, context) pairs, sorted by word then context, with their counts.

        ``log_word(words, counts)`` and ``log_pair(place of word, contexts, pair counts, log10 of words)`` give the
        smoothed values that are quantised."""
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
        words = word[begin]
        totals = np.add.reduceat(count, begin) if len(begin) else np.empty(0, np.int64)
        table, number = np.unique(context, return_inverse=True)
        run = np.repeat(np.arange(len(words)), np.diff(np.append(begin, len(word))))
        last = number[np.append(begin[1:], len(word)) - 1] if len(begin) else np.empty(0, np.int64)
        base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(begin) else np.empty(0, np.int64)
        sequence = (base[run] + number).astype(np.uint64) if len(word) else np.empty(0, np.uint64)
        q1 = cls._quantised(log_word(words, totals))
        q2 = cls._quantised(log_pair(run, context, count, q1[run] * cls.STEP)) if len(word) else np.empty(0, np.int16)
        encoded = [EliasFano.encode(x) for x in
                   (words, table, np.append(begin, len(word)).astype(np.uint64), sequence)]
        arrays = [a for _, _, *parts in encoded for a in parts]
        arrays += [totals.astype(np.int64).view(np.uint8), q1.view(np.uint8), q2.view(np.uint8)]
        head = np.zeros(32, np.int64)
        for i, (n, bits, *_) in enumerate(encoded):
            head[2 * i:2 * i + 2] = n, bits
        head[8:8 + len(arrays)] = [len(a) for a in arrays]
        arrays = [np.concatenate([a, np.zeros(-len(a) % 8, np.uint8)]) for a in arrays]
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def _quantised(cls, log10: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(log10 / cls.STEP), -32768, 32767).astype(np.int16)

    @classmethod
    def mapped(cls, blob: bytes) -> Trie:
        """The trie over a memory-mapped file without a name (it goes when the task ends)."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            return cls(mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ))

    def lookup(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, place of each pair), -1 where absent."""
        place = self.words.find(word)
        number = self.contexts.find(context)
        pair = np.full(len(word), -1, np.int64)
        ask = np.flatnonzero((place >= 0) & (number >= 0))
        begin = self.pointers.get(place[ask]).astype(np.int64)
        end = self.pointers.get(place[ask] + 1).astype(np.int64)
        # a run counts on from the end of the one before
        base = np.zeros(len(ask), np.uint64)
        later = np.flatnonzero(begin > 0)
        base[later] = self.runs.get(begin[later] - 1) + np.uint64(1)
        at = self.runs.find(base + number[ask].astype(np.uint64))
        # the run of the word: what lies beyond its end belongs to the next one
        ok = (at >= begin) & (at < end)
        pair[ask[ok]] = at[ok]
        return place, pair
