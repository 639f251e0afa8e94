"""Elias-Fano sequences and a two-level n-gram trie over one buffer.

A sequence of n ascending numbers is split into low parts of log2(universe / n) bits, one after the other, and high parts, written in unary
into a bit vector. All arrays are views of the buffer they were read from, such as a memory map, and are used in place. Queries are arrays:
each call answers all of them."""

import mmap
from collections.abc import Iterator

import numpy as np

U = np.uint64


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value one after the other in 64-bit words, and a word more."""
    parts = []
    for at in range(0, len(values) if bits else 0, 1 << 14):
        own = np.ascontiguousarray(values[at : at + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(own, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little"))
    raw = np.concatenate([*parts, np.zeros(0, np.uint8)])
    return np.append(raw, np.zeros(16 - len(raw) % 8, np.uint8)).view(U)


class EliasFano:
    def __init__(self, n: int, bits: int, low: np.ndarray, words: np.ndarray):
        self.n, self.bits, self.low, self.words = n, bits, low, words
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.ones, self.zeros = ones, np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(U)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U(bits)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        return cls(n, bits, packed_bits(values, bits), np.packbits(unary, bitorder="little").view(U))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.words]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, words: np.ndarray) -> "EliasFano":
        return cls(int(head[0]), int(head[1]), low, words)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero, from 0."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(np.ascontiguousarray(self.words[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits if ones else 1 - bits, axis=1, dtype=np.uint8)
        return word * 64 + (seen <= (k - before[word])[:, None].astype(np.uint8)).sum(1)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        place = i * self.bits
        word, shift = place >> 6, (place & 63).astype(U)
        # a part may go on in the next word; shifting by 63 and by one more is a shift by 64 where nothing does
        both = (self.low[word] >> shift) | ((self.low[word + 1] << (U(63) - shift)) << U(1))
        return both & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U)
        high = (self._select(i, True) - i).astype(U)
        return self._lows(i) | (high << U(self.bits))

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [lo, hi) with a value of x or more (hi if none), and whether it is x."""
        x = x.astype(U)
        if not len(x) or not self.n:
            return np.minimum(lo, hi), np.zeros(len(x), bool)
        high = np.minimum(x >> U(self.bits), U(self.zeros[-1])).astype(np.int64)
        # a bucket holds the values with one high part; it ends at the zero of that number
        last = int(self.words.size * 64 - self.n)  # zeros there are, padding included
        end = np.full(len(x), self.n, np.int64)
        ok = high < last
        end[ok] = np.minimum(self._select(high[ok], False) - high[ok], self.n)
        begin = np.where(ok, 0, self.n)
        mid = ok & (high > 0)
        begin[mid] = np.minimum(self._select(high[mid] - 1, False) - (high[mid] - 1), self.n)
        a, b = np.clip(begin, lo, hi), np.clip(end, lo, hi)
        stop = b.copy()
        want = x & U((1 << self.bits) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            m = (a[open_] + b[open_]) >> 1
            less = self._lows(m) < want[open_]
            a[open_[less]] = m[less] + 1
            b[open_[~less]] = m[~less]
            open_ = open_[a[open_] < b[open_]]
        found = a < stop
        found[found] = self._lows(a[found]) == want[found]
        return a, found


class Trie:
    """Predicted words, and below each the words that stood before it, with quantised log10 values at both levels.

    Children are ids of ``CHILD`` bits. To make all ranges one ascending sequence, a range's ids are counted on from
    the last value of the range before it."""

    CHILD, LEVELS = 40, 65535

    def __init__(self, words: EliasFano, pointers: EliasFano, children: EliasFano, value1: np.ndarray, value2: np.ndarray, scale: np.ndarray):
        self.words, self.pointers, self.children, self.value1, self.value2, self.scale = words, pointers, children, value1, value2, scale

    @classmethod
    def build(cls, word: np.ndarray, sizes: np.ndarray, child: np.ndarray, log1: np.ndarray, log2: np.ndarray, missing: float) -> "Trie":
        """word ascending; child ascending within each word; log1 and log2 values; missing: the value for an unknown word."""
        starts = np.cumsum(sizes) - sizes
        last = child[starts + sizes - 1].astype(U) + U(1) if len(word) else np.zeros(0, U)
        base = np.cumsum(last) - last
        low = min([missing, *(x.min() for x in (log1, log2) if len(x))])
        high = max([missing, *(x.max() for x in (log1, log2) if len(x))])
        step = (high - low) / cls.LEVELS or 1.0
        quantised = [np.rint((x - low) / step).astype(np.uint16) for x in (log1, log2)]
        return cls(EliasFano.of(word), EliasFano.of(np.append(starts, len(child))), EliasFano.of(child.astype(U) + np.repeat(base, sizes)), *quantised, np.array([low, step, missing]))

    def _value(self, q: np.ndarray) -> np.ndarray:
        return self.scale[0] + q * self.scale[1]

    def lookup(self, word: np.ndarray, sizes: np.ndarray, child: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """The value of each (word, child): its own, else the word's, else the missing one. sizes: children asked for of each word."""
        n = len(word)
        at, known = self.words.successor(word, np.zeros(n, np.int64), np.full(n, self.words.n))
        i = np.where(known, at, 0)
        out = np.full(n, self.scale[2])
        begin = end = np.zeros(n, np.int64)
        base = np.zeros(n, U)
        if self.words.n:
            begin, end = self.pointers.get(i).astype(np.int64), self.pointers.get(i + 1).astype(np.int64)
            out[known] = self._value(self.value1[at[known]])
            inner = known & (begin > 0)
            base[inner] = self.children.get(begin[inner] - 1) + U(1)
        result = np.repeat(out, sizes)
        own = np.repeat(np.arange(n), sizes)
        for a in range(0, len(child), step):
            o = own[a : a + step]
            lo, hi = begin[o], np.where(known[o], end[o], begin[o])
            place, found = self.children.successor(child[a : a + step].astype(U) + base[o], lo, hi)
            result[a : a + step][found] = self._value(self.value2[place[found]])
        return result

    def _pieces(self) -> Iterator[bytes]:
        arrays = [*self.words.arrays(), *self.pointers.arrays(), *self.children.arrays(), self.value1, self.value2, self.scale]
        yield np.array([len(arrays), *(v for a in arrays for v in (len(a), a.itemsize))], np.int64).tobytes()
        for a in arrays:
            yield a.tobytes() + b"\0" * (-a.nbytes % 8)

    def to_bytes(self) -> bytes:
        return b"".join(self._pieces())

    def mapped(self) -> "Trie":
        """The same trie over one anonymous memory map."""
        m = mmap.mmap(-1, sum(map(len, self._pieces())))
        for piece in self._pieces():
            m.write(piece)
        return Trie.from_buffer(m)

    @classmethod
    def from_buffer(cls, buffer) -> "Trie":
        """Over a bytes-like object, such as a memory-mapped file; nothing is copied."""
        n = int(np.frombuffer(buffer, np.int64, 1)[0])
        sizes = np.frombuffer(buffer, np.int64, 2 * n, 8).reshape(n, 2)
        kinds = [np.int64, U, U] * 3 + [np.uint16, np.uint16, np.float64]
        at, arrays = 8 + 16 * n, []
        for (size, _), kind in zip(sizes.tolist(), kinds, strict=True):
            arrays.append(np.frombuffer(buffer, kind, size, at))
            at += -(-size * np.dtype(kind).itemsize // 8) * 8
        return cls(*(EliasFano.from_arrays(*arrays[k : k + 3]) for k in (0, 3, 6)), *arrays[9:])
