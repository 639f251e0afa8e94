"""Periodic runs of words, by Lyndon arrays in two orders.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbour extends. The roots of a run are Lyndon
words in one of two orders, the symbols' own and its reverse: with ``after[i]`` the start of the next smaller suffix, ``[i, after[i])`` is the
longest Lyndon word at i, and it is a root of period ``q = after[i] - i`` if what follows and what comes before agree with it for q words or
more together. ``lyndon`` finds ``after`` and how far each pair ``i, after[i]`` agrees in one pass over a stack of suffixes. Nothing is compared twice:

* For one suffix, what is known of the pair before bounds the next: of three suffixes in order, the outer two agree as far as the lesser of
  the two inner agreements.
* Within a stretch that was matched with an earlier one, the answers of the earlier one are taken over; only words behind the stretch are
  compared anew, which extends it.

So neither suffix structures nor hashes are needed, only an order on the words; here that is their first occurrence in the batch.

Before that, texts are cut: a word in a run of exponent e stands ``floor(e)`` times in that run, so words that occur less often in a stretch
separate what can be runs; pieces shorter than the least length go, and the rest is cut again until nothing changes. For a whole batch
that is a few sorts. The runs within the pieces are those of the text, as a neighbour that extends a run has the same word one period on.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has no words, no runs and an empty collapsed text. Runs may
overlap and nest; each counts. Rows with the same id, or none, are rows of their own. Other columns play no part; ``keep`` copies them."""

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, own_names
from .words import trim

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Words that are cut together.
BATCH_WORDS = 1 << 17

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon(s: list[int], work: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each i the start of the next smaller suffix (the length of s, if none) and how many symbols the two suffixes agree in.

    ``work``, if given, gets the number of comparisons added to its first element."""
    n = len(s)
    after, agree = [n] * n, [0] * n
    # of the suffix that is smaller and next to the left: where it starts, and the agreement
    left, shared = [-1] * n, [0] * n
    shift, low, high = 0, 0, 0  # s[low:high] equals s[low - shift:high - shift]
    compared = 0
    for j in range(1, n):
        t = j - 1
        known, exact = 0, False  # the agreement of t and j: at least, or just so many
        while True:
            if not exact and low <= t and j < high:
                # the same pair one shift before
                u, v = t - shift, j - shift
                before = agree[u] if after[u] == v else shared[v] if left[v] == u else -1
                if before >= 0:
                    if before < high - j:
                        known, exact = before, True
                    elif high - j > known:
                        known = high - j
            if not exact:
                a, b = t + known, j + known
                while b < n and s[a] == s[b]:
                    a += 1
                    b += 1
                compared += b - j - known + 1
                known = b - j
                if b > high:
                    shift, low, high = j - t, j, b
            if j + known < n and s[t + known] < s[j + known]:
                left[j], shared[j] = t, known
                break
            after[t], agree[t] = j, known
            before, t = shared[t], left[t]
            if t < 0:
                break
            # j is below its last neighbour, and so is t
            exact = before != known
            if before < known:
                known = before
    if work is not None:
        work[0] += compared
    return after, agree


def runs(s: list[int], least_length: int = 2, least_exponent: int = 2, work: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of so many symbols and so high an exponent, by start, then period. Symbols are whole numbers."""
    n, found = len(s), set()
    for word in (s, [-x for x in s]):
        after, agree = lyndon(word, work)
        for i in range(n):
            j, far = after[i], agree[i]
            q = j - i
            # the first root within a run has at most q symbols before it
            if far < (least_exponent - 2) * q or j >= n:
                continue
            if i >= q and after[i - q] == i and agree[i - q] >= q:
                continue  # a root one period before
            back, most = 0, min(q, i)
            while back < most and s[i - 1 - back] == s[j - 1 - back]:
                back += 1
            if work is not None:
                work[0] += back + 1
            length = back + q + far
            if length >= 2 * q and length >= least_exponent * q and length >= least_length:
                found.add((i - back, length, q))
    return sorted(found)


def pieces(ids: np.ndarray, row: np.ndarray, least_length: int, least_count: int) -> Iterator[tuple[int, int]]:
    """Start and stop of the stretches of one row that may hold runs: each word is in its stretch at least ``least_count`` times."""
    at, part = np.arange(len(ids)), row.astype(np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        key = part * width + ids[at]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        count = np.diff(first, append=len(key))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(count >= least_count, count)
        kept, of = at[often], part[often]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) != 1) | (np.diff(of) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(kept))
        long = np.repeat(size >= least_length, size)
        if often.all() and long.all():
            for b, n in zip(kept[begin].tolist(), size.tolist(), strict=True):
                yield b, b + n
            return
        part = (np.cumsum(new) - 1)[long]
        at = kept[long]


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _runs_of(texts: list[list[bytes]], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    number = _Ids()
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, sum(map(len, texts)))
    ends = np.cumsum([len(words) for words in texts])
    row = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in pieces(ids, row, least_length, least_exponent):
        k = int(row[a])
        base = a - int(ends[k]) + len(texts[k])
        found[k] += [(start + base, length, q) for start, length, q in runs(ids[a:b].tolist(), least_length, least_exponent)]
    return [sorted(x) for x in found]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by a space."""
    if not found:
        return b" ".join(words)
    out, at = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in found):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return b" ".join(out + words[at:])


def _batches(column: pa.Array, ids: pa.Array, rewrite) -> Iterator[list[list[bytes]]]:
    """Lists of texts as lists of words, about ``BATCH_WORDS`` words at a time (a longer text alone)."""
    held, size = [], 0
    for text, i in zip(column, ids, strict=True):
        words = (text.as_py() or b"").split()
        if rewrite is not None:
            words = rewrite(i.as_py(), words)
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, keep: tuple[str, ...] = ("doc_id",),
    with_text: bool = True, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Every row's ``keep`` columns with ``runs`` (an array of start, length, period in words) and the text without repeated periods: ``collapsed``,
    or with ``with_text=False`` its SHA-256 in hex, ``collapsed_sha256``. Exponents are whole numbers from 2.

    ``rewrite(id, words)`` may replace a row's words (UTF-8) before runs are looked for. The work is a row's own: nothing is shuffled."""
    if least_exponent < 2 or least_exponent != int(least_exponent):
        raise ValueError("an exponent is a whole number, 2 or more")
    names = own_names(["runs", "collapsed", "collapsed_sha256"], *(f"k{i}" for i in range(len(keep))))
    given = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(id_col).alias("__id"), F.col(text).cast("binary").alias("__text"))
    last = ("collapsed", "string") if with_text else ("collapsed_sha256", "string")
    schema = T.StructType([given.schema[n] for n in names]).add("runs", T._parse_datatype_string(f"array<{RUN}>")).add(*last)
    typed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            at = 0
            for texts in _batches(batch.column("__text"), batch.column("__id"), rewrite):
                found = _runs_of(texts, least_length, least_exponent)
                left = [collapsed(words, r) for words, r in zip(texts, found, strict=True)]
                left = [x.decode() for x in left] if with_text else [sha256(x).hexdigest() for x in left]
                rows = batch.slice(at, len(texts))
                at += len(texts)
                spans = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found], typed)
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), spans, pa.array(left, pa.string())], [*names, "runs", last[0]])
            trim()

    out = materialise(given.mapInArrow(work, schema), "runs")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "runs", last[0])


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of the highest exact exponent the first run, then the one of the smallest period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def strongest_column(found) -> object:
    """``strongest`` over a column of runs: exponents are compared as whole numbers, crosswise; null without runs."""

    def better(a, b):
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (mine > other), b).otherwise(a)

    return F.aggregate(found, F.lit(None).cast(RUN), better)
