"""Substring dedup by column-wise construction of a collection's Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller doc_id. Two equal strings have the
same minimiser (the least hash among their ``PART``-byte parts), so every document is cut into fragments: runs of start positions with one
minimiser, LENGTH - 1 bytes overlapping the next. A fragment goes to the bucket of its minimiser, and equal strings
always meet in one bucket. There the fragments are short documents of one collection. Their transform is built column by column: each round inserts
one more symbol of every fragment, from the right, into the sorted list of all suffixes so far. The place of a new suffix
follows from the symbols counted above the old one; the common prefix with its neighbours is one more than the least of the
common prefixes between the old places. The lists are read and rewritten in order once a round. At the end, suffixes whose common prefix
is LENGTH or more stand together, and a group's smallest doc_id keeps its bytes.

The textbook form inserts a symbol of every whole document per round and keeps its lists in external files; with documents of
10**5 bytes that would be 10**5 passes over the corpus. Here a round is one pass over a bucket, a fragment has ``2 * LENGTH - 1``
symbols at most, and what goes through external files is Spark's shuffle of the buckets.

Most strings are in one document, so minimisers go first: a task sends each one that it meets to its bucket, with the smallest
doc_id, and what two documents have comes back to the documents by doc_id. Only fragments with such a minimiser are sent.

Before either shuffle a task keeps of equal things only that of the smallest doc_id (fragments are compared byte by byte); fragments of larger
ids are removed there and then, as all their strings are in that document. So a passage that a third of all rows hold is sent once
by each task. Equal fragments of several tasks are one row of the collection, by the same argument.

There are as many buckets as shuffle partitions, and more where a bucket would get above ``BUCKET_BYTES`` of text; a task holds one bucket at a time.

Defined results: a null text is empty. Texts under LENGTH bytes keep all. A row with a null doc_id keeps all and is no source of a match. Equal
rows need different ids: ids must be unique, and may be of any type that has an order. An empty table gives no rows. Extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from orograph.shared import numbered

from . import words as W
from .shared import materialise, own_names, packed, unpacked

LENGTH, PART, FINE_PART = 50, 20, 32
BLOCK, CHUNK, PARTS_PER_BUCKET, BUCKET_BYTES = 12 << 20, 1 << 19, 16, 32 << 20
#: Bits of a minimiser that are left out on its way; a chance meeting only makes a fragment a candidate.
SHORT, SHORTER = 16, 32


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, part: int = PART):
    """first start, end of starts, row and minimiser of the runs of start positions with one minimiser; and the running sums."""
    none, part = np.zeros(0, np.int64), min(part, length)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), None
    sums = W.running(W.BYTE[data])
    at = np.arange(len(data) - part + 1)
    least = sliding_min(W.span_hash(sums, at, at + part), length - part + 1)
    last = offsets[1:] - length  # of the starts in a row
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    good = np.arange(len(least)) <= last[row]
    new = good.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~good[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    # the run ends before the next start or at the row's last string
    stop = np.minimum(np.append(start[1:], len(least)), last[row[start]] + 1)
    return start, stop, row[start], least[start], sums


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, part: int = PART, wanted=None):
    """start, end, row, minimiser and content hash of the fragments of some texts; wanted(row, minimiser) says which runs to take."""
    start, stop, row, least, sums = runs(data, offsets, length, part)
    if wanted is not None and len(start):
        keep = wanted(row, least)
        start, stop, row, least = start[keep], stop[keep], row[keep], least[keep]
    if not len(start):
        return start, start, start, least, least
    pieces = -(-(stop - start) // length)
    which = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = start[which] + k * length
    end = np.minimum(begin + length, stop[which]) + length - 1
    return begin, end, row[which], least[which], W.span_hash(sums, begin, end)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    to = np.cumsum(size)
    return data[np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)]


def equal_spans(data, a, b, size) -> np.ndarray:
    """Whether spans at a and b of the same size hold the same bytes."""
    if not len(size):
        return np.zeros(0, bool)
    same = gather(data, a, size) == gather(data, b, size)
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def dump(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(a).to_bytes(8, "little") + a.dtype.str.ljust(4).encode() + a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def load(value: bytes) -> list[np.ndarray]:
    raw, at, out = unpacked(value), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 12].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans made one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])[: len(start)]
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] if len(start) else stop


def joined(start, stop, doc):
    """Spans in the order of (doc, start), those that touch within a document made one."""
    if not len(doc):
        return start, stop, doc
    # ends within a document, moved behind all ends of the documents before; the two numbers together stay below 2**63, as neither is above 2**31
    start, stop = start.astype(np.int64), stop.astype(np.int64)
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + base) - base
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > far[:-1]))
    at = np.flatnonzero(new)
    return start[at], far[np.append(at[1:] - 1, len(doc) - 1)], doc[at]


def number_kind(most: int):
    """The smallest unsigned kind that holds ``most``."""
    return next(k for k in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(k).max)


class Block:
    """What a task has read and not sent yet."""

    def __init__(self, buckets: int, length: int):
        self.buckets, self.length, self.parts, self.size = buckets, length, [], 0

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, wanted=None) -> None:
        start, end, row, least, content = fragments(data, offsets, self.length, wanted=wanted)
        self.parts.append((data, start, end - start, ids[row], start - offsets[:-1][row], least, content))
        self.size += len(data)

    def send(self):
        """(bucket, payload) rows. A payload: minimisers, sizes and bytes of contents; content, doc_id and place of
        entries; doc_id, start and stop of what is removed already."""
        if not self.parts:
            return
        shift = np.cumsum([0] + [len(p[0]) for p in self.parts])
        data = np.concatenate([p[0] for p in self.parts])
        start, size, doc, place, least, content = (np.concatenate([p[i] + (shift[k] if i == 1 else 0) for k, p in enumerate(self.parts)]) for i in range(1, 7))
        self.parts, self.size = [], 0
        order = np.lexsort((place, doc, content))
        start, size, doc, place, least, content = (x[order] for x in (start, size, doc, place, least, content))
        first = np.append(True, content[1:] != content[:-1])[: len(start)]
        head = np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
        same = (size == size[head]) & ~first
        at = np.flatnonzero(same)
        same[at] = equal_spans(data, start[at], start[head[at]], size[at])
        first = ~same  # a content hash that meets by chance is a content of its own
        gone = same & (doc != doc[head])
        yield from self._removed(doc[gone], place[gone], size[gone])
        keep = ~gone
        start, size, doc, place, least, first = (x[keep] for x in (start, size, doc, place, least, first))
        number = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        bucket = (least[heads] % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((least[heads], bucket))
        new = np.empty(len(heads), np.int64)
        new[order] = np.arange(len(heads))
        heads, bucket = heads[order], bucket[order]
        owner = new[number]
        entry = np.argsort(owner, kind="stable")
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        cuts = np.searchsorted(owner[entry], edges)
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            h, e = heads[edges[b] : edges[b + 1]], entry[cuts[b] : cuts[b + 1]]
            high = (least[h] >> np.uint64(32)).astype(np.uint32)
            # sorted by the whole minimiser, so differences are small
            yield int(b), dump(np.diff(high, prepend=np.uint32(0)), size[h].astype(number_kind(2 * self.length)), gather(data, start[h], size[h]),
                               np.diff(owner[e] - edges[b], prepend=0).astype(np.uint8), doc[e], place[e].astype(np.int32))

    def _removed(self, doc, place, size):
        order = np.lexsort((place, doc))
        start, stop, doc = joined(place[order], place[order] + size[order], doc[order])
        for ids in np.array_split(np.arange(len(doc)), max(1, len(doc) // 100_000)):
            if len(ids):
                yield int(doc[ids[0]] % self.buckets), dump(doc[ids], start[ids].astype(np.int32), stop[ids].astype(np.int32))


def column_wise(data: np.ndarray, start: np.ndarray, size: np.ndarray):
    """The sorted suffixes of a collection: fragment, suffix length and common prefix with the one above."""
    n = len(start)
    end = start + size
    who = np.arange(n, dtype=np.int32)
    kind = number_kind(int(size.max(initial=0)))
    long_ = np.zeros(n, kind)
    common = np.zeros(n, kind)
    before = data[end - 1].astype(np.int16) if n else np.zeros(0, np.int16)  # the transform; -1 where a fragment begins
    at = np.arange(n)  # place of each fragment's longest suffix
    live = np.arange(n)
    for length in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= length]
        rank = np.argsort(before, kind="stable")  # by radix: the symbols are short numbers
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        ends = int(np.count_nonzero(before < 0))
        to = place[at[live]]
        # common prefixes of the new suffixes and of those just below them
        flag = np.zeros(len(rank) + 1, bool)
        flag[to] = flag[to + 1] = True
        touched = np.flatnonzero(flag[: len(rank)])
        lower, upper = rank[touched], rank[touched - 1]
        same = (before[lower] == before[upper]) & (touched > ends)
        value = np.zeros(len(touched), kind)
        if same.any():
            pairs = np.empty(2 * int(same.sum()), np.int64)
            pairs[::2], pairs[1::2] = upper[same] + 1, lower[same] + 1
            value[same] = np.minimum.reduceat(np.append(common, kind(0)), pairs)[::2] + 1
        shift = n - ends
        to += shift
        total = len(rank) - ends + n
        old = np.ones(total, bool)
        old[to] = False
        grown = np.empty(total, np.int32), np.empty(total, kind), np.empty(total, kind), np.empty(total, np.int16)
        for new, was in zip(grown, (who, long_, common, before), strict=True):
            new[old] = was
        who, long_, common, before = grown
        where = end[live] - length
        who[to], long_[to] = live, length
        before[to] = np.where(size[live] > length, data[np.maximum(where - 1, 0)].astype(np.int16), np.int16(-1))
        common[touched + shift] = value
        at[live] = to
    return who, long_, common


def find_matches(data, start, size, doc, length: int = LENGTH):
    """item, first and last place of every run of strings of ``length`` bytes that also are in an item with a smaller doc, by the transform."""
    who, long_, common = column_wise(data, start, size)
    rows = np.flatnonzero(long_ >= length)
    if not len(rows):
        return rows, rows, rows
    group = np.cumsum(common < length)[rows]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    owner = doc[who[rows]]
    least = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(rows))))
    rows = rows[owner > least]
    item, place = who[rows].astype(np.int64), size[who[rows]] - long_[rows]
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1))[: len(item)])
    return item[new], place[new], place[np.append(new[1:] - 1, len(item) - 1)] if len(new) else place


def met_by_two(least: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an item's minimiser is in items of two documents."""
    if not len(least):
        return np.zeros(0, bool)
    order = np.argsort(least, kind="stable")
    edge = np.flatnonzero(np.append(True, least[order][1:] != least[order][:-1]))
    several = np.minimum.reduceat(doc[order], edge) != np.maximum.reduceat(doc[order], edge)
    out = np.empty(len(least), bool)
    out[order] = np.repeat(several, np.diff(np.append(edge, len(least))))
    return out


def spread(item, first, last, of):
    """What was found for leaders, for all items that they stand for; ``of`` gives each item's leader."""
    order = np.argsort(item, kind="stable")
    item, first, last = item[order], first[order], last[order]
    lo, hi = np.searchsorted(item, of, "left"), np.searchsorted(item, of, "right")
    times = hi - lo
    who = np.repeat(np.arange(len(of)), times)
    row = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
    return who, first[row], last[row]


def resolve(data, start, size, doc, least, length: int = LENGTH, fine: bool = False):
    """item, start and stop of what goes, for items (strings in ``data``) of one bucket: equal items are one, what is left of a minimiser that one
    document has is out, items are cut once more by longer parts, and what still shares a part but isn't equal is matched by the transform."""
    none = np.zeros(0, np.int64)
    use = np.flatnonzero(met_by_two(least, doc))
    if not len(use):
        return none, none, none
    # at most 100 bytes each, so the running sums are taken over some thousand items at a time
    text = gather(data, start[use], size[use])
    to = np.cumsum(size[use])
    at = to - size[use]
    content = np.concatenate([W.span_hash(W.running(W.BYTE[text[at[u[0]] : to[u[-1]]]]), at[u] - at[u[0]], to[u] - at[u[0]]) for u in np.array_split(np.arange(len(use)), 1 + len(use) // 8000)])
    order = np.lexsort((doc[use], content))
    head = order[np.maximum.accumulate(np.where(np.append(True, content[order][1:] != content[order][:-1]), np.arange(len(use)), 0))]
    same = (size[use[order]] == size[use[head]]) & (order != head)
    k = np.flatnonzero(same)
    same[k] = equal_spans(text, at[order[k]], at[head[k]], size[use[order[k]]])
    leader = np.empty(len(use), np.int64)
    leader[order] = np.where(same, head, order)
    gone = np.flatnonzero(doc[use] > doc[use[leader]])
    out = [(use[gone], np.zeros(len(gone), np.int64), size[use[gone]])]
    heads = np.flatnonzero(leader == np.arange(len(use)))
    heads = heads[met_by_two(least[use[heads]], doc[use[heads]])]
    if len(heads):
        items = use[heads]
        if fine:
            found, first, last = find_matches(data, start[items], size[items], doc[items], length)
            last = last + length
        else:
            found, first, last = none, none, none
            own = gather(data, start[items], size[items])
            edges = np.append(0, np.cumsum(size[items]))
            cuts = [[] for _ in range(4)]
            for u in np.array_split(np.arange(len(items)), 1 + len(items) // 8000):
                a, b, row, m, _ = fragments(own[edges[u[0]] : edges[u[-1] + 1]], edges[u[0] : u[-1] + 2] - edges[u[0]], length, FINE_PART)
                for c, v in zip(cuts, (a + edges[u[0]], b + edges[u[0]], row + u[0], m), strict=True):
                    c.append(v)
            a, b, row, m = (np.concatenate(c) for c in cuts)
            i, p, q = resolve(own, a, b - a, doc[items][row], m, length, True)
            found, first, last = row[i], p + a[i] - edges[row[i]], q + a[i] - edges[row[i]]
        # back to all that the leaders stand for, in their own document
        place = np.full(len(use), -1)
        place[heads] = np.arange(len(heads))
        follow = np.flatnonzero((place[leader] >= 0) & (doc[use] == doc[use[leader]]))
        who, first, last = spread(found, first, last, place[leader[follow]])
        out.append((use[follow[who]], first, last))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def bucket_removals(payloads: list[list[np.ndarray]], length: int = LENGTH):
    """doc_id, start, stop of what goes, from all payloads of a bucket."""
    out = [tuple(x.astype(np.int64) for x in p) for p in payloads if len(p) == 3]
    parts = [p for p in payloads if len(p) == 6]
    if parts:
        high = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        data = np.concatenate([p[2] for p in parts])
        base = np.cumsum([0] + [len(p[1]) for p in parts])
        owner = np.concatenate([np.cumsum(p[3], dtype=np.int64) + base[k] for k, p in enumerate(parts)])
        doc = np.concatenate([p[4] for p in parts])
        place = np.concatenate([p[5] for p in parts]).astype(np.int64)
        start = np.cumsum(size) - size
        holder = doc[np.searchsorted(owner, np.arange(len(size)))]  # entries of a content stand together and have one doc
        for k in range(PARTS_PER_BUCKET):  # so that the lists of a collection stay in a processor's cache
            own = np.flatnonzero(high % np.uint32(PARTS_PER_BUCKET) == k)
            item, a, b = resolve(data, start[own], size[own], holder[own], high[own], length)
            item = own[item]
            # every entry of a content
            lo, hi = np.searchsorted(owner, item, "left"), np.searchsorted(owner, item, "right")
            times = hi - lo
            e = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            out.append((doc[e], place[e] + np.repeat(a, times), place[e] + np.repeat(b, times)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, all lowest ones first: what is zero compresses to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def unplaned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").reshape(-1)


def send_minimisers(doc: np.ndarray, least: np.ndarray, buckets: int):
    """(bucket, payload) rows of a block: each minimiser once, with its smallest doc_id; and, for those that several of the
    block's documents have, all of these documents, as nothing more needs to be known of them. Minimisers that only differ in
    the bits left out are one within a bucket, never across buckets: each must reach its own."""
    bucket = (least % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    least = least >> np.uint64(SHORT)
    order = np.lexsort((doc, least, bucket))
    doc, least, bucket = doc[order], least[order], bucket[order]
    other = (least[1:] != least[:-1]) | (bucket[1:] != bucket[:-1])
    new = np.append(True, other | (doc[1:] != doc[:-1]))[: len(doc)]
    doc, least, bucket = doc[new], least[new], bucket[new]
    first = np.append(True, (least[1:] != least[:-1]) | (bucket[1:] != bucket[:-1]))[: len(doc)]
    times = np.diff(np.append(np.flatnonzero(first), len(doc)))
    several = np.repeat(times > 1, times)
    known = np.flatnonzero(several)
    known = known[np.argsort(doc[known], kind="stable")]
    for part in np.array_split(known, max(1, len(known) // 200_000)):
        if len(part):
            yield int(doc[part[0]] % buckets), dump(doc[part], planes(least[part]))
    doc, least, bucket = doc[first], least[first], bucket[first]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        i = slice(edges[b], edges[b + 1])
        ids, place = np.unique(doc[i], return_inverse=True)
        yield int(b), dump(ids, place.astype(np.uint16 if len(ids) < 65536 else np.uint32), planes(np.diff(least[i], prepend=np.uint64(0))))


def shared_minimisers(payloads: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and minimiser of all that is in two documents or more."""
    known = [(p[0], unplaned(p[1])) for p in payloads if len(p) == 2]
    parts = [(p[0][p[1]], np.cumsum(unplaned(p[2]), dtype=np.uint64)) for p in payloads if len(p) == 3]
    if parts:
        doc, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(least, kind="stable")
        doc, least = doc[order], least[order]
        edge = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        several = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
        keep = np.repeat(several, np.diff(np.append(edge, len(doc))))
        known.append((doc[keep], least[keep]))
    return tuple(np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def by_bucket(batches):
    """The decoded payloads of one bucket at a time; rows come sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != bucket and held:
                yield held
                held = []
            bucket = b
            held.append(load(value.as_py()))
    if held:
        yield held


def sent_rows(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["bucket", "payload"])


def dealt(doc: np.ndarray, parts: int, *values: np.ndarray) -> pa.RecordBatch:
    """What a bucket has found, in one row for each part of the documents: ids and values in the order of the ids."""
    part = (W.mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((doc, part))
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, order[edges[p] : edges[p + 1]]) for p in np.flatnonzero(edges[1:] > edges[:-1])]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([dump(doc[i], *(v[i] for v in values)) for _, i in rows], pa.binary())], ["part", "payload"])


def gathered(found: DataFrame, tasks: int) -> DataFrame:
    """``doc_id, found``: one row a document with all that the buckets have found of it (arrays as ``dump`` packs them), from the rows of ``dealt``."""

    def gather_(batches):
        for parts in by_bucket(batches):
            doc, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, lists = by_document(doc, *values)
            kinds = [v.dtype for v in values]
            for at in range(0, len(ids), 10_000):
                cut = slice(at, at + 10_000)
                packs = [dump(*(np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))) for row in zip(*(v[cut] for v in lists), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array(packs, pa.binary())], ["doc_id", "found"])

    return found.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(gather_, "doc_id long, found binary")


def by_document(doc: np.ndarray, *values: np.ndarray):
    """The ids in order, and for each array the values of every id as bytes."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    return doc[edge], [[x.tobytes() for x in np.split(v[order], edge[1:])] if len(edge) else [] for v in values]


def candidates(source: DataFrame, length: int, tasks: int, buckets: int) -> DataFrame:
    """``doc_id, found`` (the high 4 bytes of each): for each document the minimisers that another document has too."""

    def anchors(batches):
        docs, least, size = [], [], 0
        for part, data, offsets in W.chunks(batches, "text", CHUNK):
            _, _, row, m, _ = runs(data, offsets, length)
            docs.append(part.column(0).to_numpy(zero_copy_only=False)[row])
            least.append(m)
            size += len(data)
            if size >= BLOCK:
                yield sent_rows(send_minimisers(np.concatenate(docs), np.concatenate(least), buckets))
                docs, least, size = [], [], 0
        if docs:
            yield sent_rows(send_minimisers(np.concatenate(docs), np.concatenate(least), buckets))

    def share(batches):
        for payloads in by_bucket(batches):
            doc, least = shared_minimisers(payloads)
            yield dealt(doc, buckets, (least >> np.uint64(SHORTER - SHORT)).astype(np.uint32))

    sent = source.mapInArrow(anchors, "bucket int, payload binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return gathered(sent.mapInArrow(share, "part int, payload binary"), tasks)


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, found`` (starts and sizes as ``dump`` packs them; they may overlap), a row for each document that loses bytes. Ids are 64-bit numbers."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(tasks, -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    shared = candidates(source, length, tasks, buckets)
    texts = source.select("doc_id", packed("text").alias("t")).join(shared, "doc_id").select("doc_id", "t", "found")

    def cut(batches):
        block = Block(buckets, length)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lists = [load(x)[0] for x in part.column(2).to_pylist()]
                number = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                known = np.sort(W.keyed(number, np.concatenate(lists).astype(np.uint64)))
                values = [unpacked(x) for x in part.column(1).to_pylist()]
                data = np.frombuffer(b"".join(values), np.uint8)
                offsets = np.cumsum([0, *map(len, values)])

                def wanted(row, least, known=known):
                    key = W.keyed(row, least >> np.uint64(SHORTER))
                    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key

                block.add(ids, data, offsets, wanted)
                if block.size >= BLOCK:
                    yield sent_rows(block.send())
        yield sent_rows(block.send())
        W.trim()

    def match(batches):
        for payloads in by_bucket(batches):
            doc, start, stop = bucket_removals(payloads, length)
            order = np.lexsort((start, doc))
            start, stop, doc = joined(start[order], stop[order], doc[order])
            yield dealt(doc, buckets, start.astype(np.int32), (stop - start).astype(np.int32))

    sent = texts.mapInArrow(cut, "bucket int, payload binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return gathered(sent.mapInArrow(match, "part int, payload binary"), tasks)


def cut_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops`` and, if asked for, ``kept`` (the bytes that remain) of each row."""
    if not isinstance(docs.schema[doc_id].dataType, (ByteType, ShortType, IntegerType, LongType)):
        # other ids are numbered in their order
        number, own = own_names(docs.columns, "number_of", "id_of")
        ids = numbered(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias(own)).distinct(), [F.col(own)], number)
        ids = materialise(ids, "numbers")
        found = cut_repeats(docs.join(ids, docs[doc_id] == ids[own], "left"), length, number, text, with_bytes)
        return found.join(ids, found["doc_id"] == ids[number], "left").select(F.col(own).alias("doc_id"), *found.columns[1:])
    spans = repeated_spans(docs, length, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("id"), packed(text).alias("t")).join(spans, F.col("id") == F.col("doc_id"), "left").select("id", "t", "found")
    kind = docs.schema[doc_id].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cols = [[] for _ in range(7)]
                for i in range(len(part)):
                    data = unpacked(part.column(1)[i].as_py())
                    found = part.column(2)[i].as_py()
                    a, n = (x.astype(np.int64) for x in load(found)) if found else np.zeros((2, 0), np.int64)
                    a, b = merged_spans(a, a + n)
                    begin, stop = np.append(0, b).tolist(), np.append(a, len(data)).tolist()
                    kept = b"".join(data[x:y] for x, y in zip(begin, stop, strict=True)) if len(a) else data
                    for c, v in zip(cols, (len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), a, b, kept if with_bytes else None), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"]
    return materialise(rows.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, stops array<int>, kept binary"), "cut")
