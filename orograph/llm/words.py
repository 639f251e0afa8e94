"""Words and their hashes for whole Arrow batches, with numpy inside a task.

Words are runs of bytes other than space and 0x09-0x0D; in UTF-8 such bytes are never part of a longer character, so byte
runs are character runs. Hashes are 64-bit polynomials over a table of random bytes, differences of one running sum. Modulo a power of two such
polynomials have pairs that collide whatever the table and the radix, from about a thousand terms on: so words over ``LONG`` bytes are known
by a digest instead, and where equal hashes must mean equal bytes, ``exact`` compares these."""

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Chosen once at random; the multiplier is odd, so it has an inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15 | 1
BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 64, 256, U)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word from which on its hash is a digest.
LONG = 256


def trim() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``most`` bytes of text (a longer text alone), with their bytes and the offsets of each row's text;
    null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, column, data
        trim()


@lru_cache(8)
def _powers(n: int, radix: int) -> np.ndarray:
    x = np.full(n, radix, U)
    x[0] = 1
    return np.cumprod(x, dtype=U)


def powers(n: int, radix: int = RADIX) -> tuple[np.ndarray, np.ndarray]:
    """radix**i and radix**-i for i below n, modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    return _powers(size, radix)[:n], _powers(size, pow(radix, -1, 1 << 64))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def running(values: np.ndarray) -> np.ndarray:
    """Sums P with P[j] - P[i] = sum of values[k] * RADIX**k for i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    if len(values):
        np.cumsum(values * powers(len(values))[0], dtype=U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    inside = ~SPACE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hashes of words, taken for about ``most`` bytes at a time, so that a very long text needs 8 bytes a word and no running sums over all of it."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + most, "right")))
        if end[at] - start[at] <= most:  # else one word, and a long one
            out[at:to] = span_hash(running(BYTE[data[start[at] : end[to - 1]]]), start[at:to] - start[at], end[at:to] - start[at])
        at = to
    for i in np.flatnonzero(end - start > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def exact(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Numbers below ``2 * len(start)`` that are equal just where the spans' bytes are, given hashes that are equal for equal bytes.

    Each span is compared with the first of its hash, about ``most`` bytes at a time. Spans that differ from it are numbered anew by their bytes."""
    first, number = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    size, lead = end - start, first[number]
    differs = size != size[lead]
    rest = np.flatnonzero((lead != np.arange(len(start))) & ~differs & (size > 0))
    sums = np.concatenate([[0], np.cumsum(size[rest])])
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        part = rest[at:to]
        if to == at + 1:
            i, j = part[0], lead[part[0]]
            differs[i] = not np.array_equal(data[start[i] : end[i]], data[start[j] : end[j]])
        else:
            n = size[part]
            inner = np.arange(sums[to] - sums[at]) - np.repeat(sums[at:to] - sums[at], n)
            unlike = data[np.repeat(start[part], n) + inner] != data[np.repeat(start[lead[part]], n) + inner]
            differs[part] = np.add.reduceat(unlike, sums[at:to] - sums[at]) > 0
        at = to
    if differs.any():
        number, known = number.copy(), {}
        for i in np.flatnonzero(differs):
            number[i] = known.setdefault((number[i], data[start[i] : end[i]].tobytes()), len(first) + len(known))
    return number


def exact_windows(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers that are equal just where the n numbers from each place ``at`` on are; n is a power of two, and all windows lie within."""
    width = 1
    while width < n:
        if len(numbers) <= width:
            return np.zeros(0, np.int64)
        pairs = numbers[:-width] * (int(numbers.max()) + 1) + numbers[width:]
        numbers = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    return numbers[at]


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and hash of every n words in a row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return at, span_hash(running(hashes), at, at + n)


def keyed(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of both."""
    return mix(hashes ^ mix(row.astype(U) + U(0x632BE59BD9B4E019)))


def per_row(row: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(row, weights, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
