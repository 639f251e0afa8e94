"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles (words lower-cased in A-Z), each labelled with which occurrence of the same
shingle it is. For each of ``SEEDS`` hash functions the sketch takes the ``LENGTH`` labelled shingles of smallest hash and keeps
them in the order of the text; two documents are candidates if one of their sketch entries is equal. The chance of that for one
entry is about ``s**LENGTH`` at similarity s and falls when shared shingles stand in another order; at s = 0.8 all 32
entries differ once in 10**7 pairs of long texts, once in 10**5 of nine shingles, and of fewer all that are alike are candidates. A candidate pair is verified by aligning the two shingle sequences within the band that the
threshold allows: with ``m`` shingles matched in order, the similarity is ``m / (n1 + n2 - m)``, and 0.8 or more is a link.
Classes are the connected components of links.

Documents with the same words in the same order form one class before any sketching. Of the rest, first every member of a
sketch group is compared with the group's hub. Then, where several components are left around a hub, pairs between components
are compared too, but for those that what was learned about either and the hub rules out (see ``_sharing`` and ``_by_pivots``). So a large
group of near copies costs about as many comparisons as it has members, and no candidate pair that could be alike is left out. A pair
between components also needs sizes that allow 0.8 and one-bit sketches of 128 bits that differ in 32 at most (expected 13 at
0.8, deviation 3.4).

Defined results: a text without words (null, empty, blank) is a class of its own. A text of one to four words is one shingle.
The class id is the smallest doc_id; that document stays. Ids must be unique; rows that repeat an id and its words count once
in comparisons and each get the class. Extra columns are carried by ``drop_near``. An empty table gives no rows. Texts are read
whole; a very long text has a band of a ninth of both lengths, and its alignment the memory of that.
"""

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components, extended
from .shared import materialise, own_names, packed, size_of, unpacked, with_verdicts

SHINGLE, SIMILARITY = 5, 0.8
SEEDS, LENGTH = 32, 4
MOST_BITS = 32
RARE = 16
#: Up to so many shingles, sequences that are alike are the same but for one item.
FEW = 8
#: Rounds of pivots around a hub, and pairs for each member, beside some anyway, from which on a round is made.
ROUNDS, MANY, ANYWAY = 8, 16, 100_000
_random = np.random.Generator(np.random.PCG64(977))
SALTS = _random.integers(0, 1 << 64, SEEDS, np.uint64)[:, None]
PLACE = _random.integers(0, 1 << 64, LENGTH, np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of each row's shingles in the order of the text; data is lower-cased."""
    start, end, row = W.words(data, offsets)
    hashes = W.word_hashes(data, start, end)
    del start, end
    at, wide = W.windows(hashes, row, SHINGLE)
    n = len(offsets) - 1
    out = np.split(wide, np.searchsorted(row[at], np.arange(1, n)))
    few = np.bincount(row, minlength=n) if len(row) else np.zeros(n, int)
    for i in np.flatnonzero((few > 0) & (few < SHINGLE)):
        a = np.searchsorted(row, i)
        out[i] = W.span_hash(W.running(hashes[a : a + few[i]]), np.array([0]), np.array([few[i]]))
    return out


def labelled(own: np.ndarray) -> np.ndarray:
    """Each shingle's hash with its occurrence number mixed in."""
    order = np.argsort(own, kind="stable")
    new = np.append(True, own[order][1:] != own[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    number = np.empty(len(own), np.uint64)
    number[order] = (np.arange(len(own)) - first).astype(np.uint64)
    return W.mix(own + number * np.uint64(0xA24BAED4963EE407))


def one_less(own: np.ndarray) -> np.ndarray:
    """Hashes of a short sequence and of the sequence without each of its items: of so few items two that are alike differ by one at most."""
    n = len(own)
    rest = [own, *(np.delete(own, i) for i in range(n))] if n > 1 else [own]
    flat = np.concatenate(rest)
    size = np.array([len(x) for x in rest])
    end = np.cumsum(size)
    return W.span_hash(W.running(flat), end - size, end) ^ np.uint64(0x6C62272E07BB0142)


def sketch(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order-preserving sketch (one hash an entry) and two words of one-bit minima."""
    items = labelled(own)
    k = min(LENGTH, len(items))
    least = np.empty((SEEDS, k), np.int64)
    step = max(1, (1 << 20) // max(1, len(items)))  # of a long text a few hash functions at a time
    for at in range(0, SEEDS, step):
        ranks = (items[None, :] ^ SALTS[at : at + step]) * np.uint64(0x9FB21C651E98DF25)
        ranks ^= ranks >> np.uint64(29)
        least[at : at + step] = np.argpartition(ranks, k - 1, axis=1)[:, :k] if k < len(items) else np.arange(k)
    least.sort(axis=1)
    with np.errstate(over="ignore"):
        entries = W.mix((items[least] * PLACE[:k]).sum(1, dtype=np.uint64) ^ SALTS[:, 0])
    if len(own) <= FEW:
        entries = np.append(entries, one_less(own))
    by = np.sort(items)
    bins, first = np.unique(by >> np.uint64(57), return_index=True)
    bits = np.zeros(128, np.uint8)
    bits[bins.astype(int)] = (W.mix(by[first]) & np.uint64(1)).astype(np.uint8)
    return entries.view(np.int64), np.packbits(bits).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether an alignment within the band matches enough shingles."""
    total = len(a) + len(b)
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if not total or need > min(len(a), len(b)):
        return False
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)) or np.isin(a, b).sum() < need:
        return False
    return matched(a.tolist(), b.tolist(), int(total * (1 - least) / (1 + least)) + 1) >= need


def matched(a: list, b: list, band: int) -> int:
    """The most items that an alignment of a and b matches in order, none further than ``band`` places apart: bit-parallel over a window of a's places.

    Bit i of ``row`` stands for place ``base + i`` of a; a zero is a match. Places that the window leaves behind can't change any more, so
    their zeros are counted and dropped: memory is that of the band beside the two lists."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    slack = max(64, band)
    width = 2 * band + 1 + slack
    full = (1 << width) - 1
    row, base, done = full, 0, 0
    for j, y in enumerate(b):
        found = places.get(y)
        if found is None:
            continue
        if j - band > base + slack:
            shift = j - band - base
            done += shift - (row & ((1 << shift) - 1)).bit_count() if shift < width else width - row.bit_count()
            row = (row >> shift | full << max(0, width - shift)) & full
            base += shift
        lo, hi = bisect_left(found, j - band), bisect_right(found, j + band)
        if hi - lo > 64:  # a shingle said very often: its bits at once
            flags = np.zeros(width, np.uint8)
            flags[np.array(found[lo:hi]) - base] = 1
            hit = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little") & row
        else:
            hit = 0
            for i in found[lo:hi]:
                hit |= 1 << (i - base)
            hit &= row
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return done + width - row.bit_count()


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, same`` (digest of the words), ``n`` shingles, ``bits``, ``entries`` of the rows that have words."""

    def run(batches):
        for rows, data, offsets in W.chunks(batches, "text", 1 << 18):
            data = W.LOWER[data]
            keep, same, n, bits, entries = [], [], [], [], []
            for i, own in enumerate(shingles(data, offsets)):
                if len(own):
                    e, b = sketch(own)
                    keep.append(i)
                    same.append(hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).digest()[:16])
                    n.append(len(own))
                    bits.append(b)
                    entries.append(e)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(keep, pa.int64())), pa.array(same, pa.binary()), pa.array(n, pa.int64()),
                pa.array([x[0] for x in bits], pa.int64()), pa.array([x[1] for x in bits], pa.int64()), pa.array(entries, pa.list_(pa.int64()))],
                ["id", "same", "n", "bits0", "bits1", "entries"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, same binary, n long, bits0 long, bits1 long, entries array<long>")


def _near(a: str, b: str):
    """The cheap conditions on a candidate pair."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("bits0", "bits1")), F.lit(0))
    return (small >= large * SIMILARITY) & (apart <= MOST_BITS)


def by_size(batch: pa.RecordBatch, columns, most: int):
    """Slices of a batch whose packed texts have about ``most`` bytes together when unpacked; a longer row is alone."""
    sizes = sum(np.array([size_of(x.as_py()) for x in batch.column(c)], np.int64) for c in columns)
    ends, at = np.cumsum(sizes), 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (a, b), by their texts (id, t as ``packed``): whether they are ``alike``, and of b how many labelled shingles it
    has and which of them (``extra``) a lacks."""

    def run(batches):
        for batch in batches:
            for rows in by_size(batch, (2, 3), 1 << 19):
                sides = []
                for c in (2, 3):
                    values = [unpacked(x) for x in rows.column(c).to_pylist()]
                    data = np.frombuffer(b"".join(values), np.uint8)
                    sides.append(shingles(W.LOWER[data], np.cumsum([0, *map(len, values)])))
                good = [alike(x, y) for x, y in zip(*sides, strict=True)]
                extra = [np.setdiff1d(labelled(y), labelled(x)).view(np.int64) for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(good, pa.bool_()), pa.array(extra, pa.list_(pa.int64()))], ["a", "b", "alike", "extra"])
            W.trim()

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, alike boolean, extra array<long>")


def _sharing(star: DataFrame, checked: DataFrame, part: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one star that share a rare shingle, may be alike and are in different components; and the members whose
    common shingles may be enough for the threshold.

    star: hub, id, n, bits, at most ``count`` rows; checked: what ``verify`` said of hubs and members; part: id, component.
    Shingles that a star's hub lacks and at most ``RARE`` of its members have are rare there. Two members that share a rare
    shingle are a pair (at most RARE for each). Two that share none have no more shingles in common than either has common ones,
    so unless those are enough for the threshold the pair is out, and needs no comparison."""
    of = star.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = of.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n")).where("lo != hi").select("hub", "least_n")
    info = checked.select(F.col("a").alias("hub"), F.col("b").alias("id"), "extra")
    of = materialise(of.join(several, "hub").join(info, ["hub", "id"], "left"), "star", count)
    near = of.where(F.col("extra").isNotNull())  # all but the hub
    each = near.select("hub", "id", "n", "bits0", "bits1", "component", F.explode("extra").alias("shingle"))
    rare = each.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE)
    each = materialise(each.join(rare, ["hub", "shingle"]), "rare")
    x, y = each.where("k > 1").alias("x"), each.where("k > 1").alias("y")
    apart = F.col("x.component") != F.col("y.component")
    sharing = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & apart & _near("x", "y")).select(*_pair())
    # a member's common shingles bound the size of what it can be alike to without a rare one
    common = near.withColumn("lacks", F.size("extra")).drop("extra", "component").join(each.groupBy("hub", "id").agg(F.count(F.lit(1)).alias("rare")), ["hub", "id"], "left")
    common = common.withColumn("most", F.floor((F.col("n") - F.coalesce("rare", F.lit(0))) * ((1 + SIMILARITY) / SIMILARITY) + 1e-9) - F.col("n"))
    common = common.where(F.col("most") >= F.greatest("least_n", F.ceil(F.col("n") * SIMILARITY - 1e-9)))
    return sharing.distinct(), materialise(common.drop("rare", "least_n"), "common", count)


def _pair():
    return F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")


def _cells(rows: DataFrame, around: bool) -> DataFrame:
    """rows with ``band``, of their size, and ``cell``, of how far they are from their hub, for equal joins; around: with the neighbours of both.

    In shingles regardless of order, twice what a member has and the hub lacks, less the member's size, is its distance from the hub
    but for a constant. That is a metric, so what is alike, which leaves at most a ninth of both sizes unmatched, is as near as that here. Bands grow
    by a quarter, and a band's cells are as wide as a ninth of the largest two sizes that meet in it."""
    near = lambda x: F.explode(F.array(x - 1, x, x + 1)) if around else x
    rows = rows.withColumn("band", near(F.floor(F.log("n") / float(np.log(1 / SIMILARITY)) + 1e-9)))
    wide = F.pow(F.lit(1 / SIMILARITY), F.col("band") + 1) * ((1 + 1 / SIMILARITY) * (1 - SIMILARITY) / (1 + SIMILARITY))
    return rows.withColumn("cell", near(F.floor((2 * F.col("lacks") - F.col("n")) / wide)))


def _by_pivots(common: DataFrame, links: DataFrame, part: DataFrame, texts: DataFrame) -> DataFrame:
    """links with those that are missing between members of a star without a rare shingle in common.

    A star's largest component needs no comparisons within. While the pairs of members of different components that are near enough are
    many, a round compares one pivot of each cell with all that is near it: what is like the pivot becomes one component, and the pivot is done. So a large
    group of near copies takes one round. The pairs that are left are compared."""
    count = common.count()
    for turn in range(ROUNDS + 1):
        of = common.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = of.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("hub").agg(F.max(F.struct("k", "component")).alias("major"))
        of = materialise(of.join(sizes.select("hub", F.col("major.component").alias("major")), "hub"), "members", count)
        rest = of.where("component != major")
        # of the two sides the smaller one has its neighbours' cells: a hub's largest component is a row for each member
        x, y = _cells(rest, True), _cells(of, False)
        key = ["hub", "band", "cell"]
        met = x.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("nx")).join(y.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("ny")), [*key, "component"], "full")
        met = met.groupBy(*key).agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"), F.sum(F.col("nx") * F.col("ny")).alias("same"))
        pairs = met.agg(F.sum(F.col("nx") * F.col("ny") - F.coalesce("same", F.lit(0)))).first()[0] or 0
        if not pairs:
            return links
        last = turn == ROUNDS or pairs <= MANY * count + ANYWAY
        if not last:
            alone = _cells(rest, False)
            pivots = materialise(alone.groupBy(*key).agg(F.min(F.struct("id", *(c for c in rest.columns if c not in ("hub", "id")))).alias("p")).select("hub", "p.*"), "pivots", count)
            x = _cells(pivots, True)
        x, y = x.alias("x"), y.alias("y")
        equal = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") != F.col("y.component"))
        enough = (F.col("x.most") >= F.col("y.n")) & (F.col("y.most") >= F.col("x.n")) & _near("x", "y")
        found = materialise(verify(x.join(y, equal & enough).select(*_pair()).distinct(), texts).where("alike").select("a", "b"), "found")
        links = materialise(links.union(found).distinct(), "links")
        if last:
            return links
        part = materialise(extended(part, found), "part", 2 * links.count())
        common = materialise(common.join(pivots.select("hub", "id"), ["hub", "id"], "left_anti"), "common", count)
        count = common.count()
    return links


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, kept`` for every row of docs. n_links: verified links of the text that stands for the row's
    copies."""
    rows = materialise(sketches(docs, doc_id, text), "sketch")
    stands = materialise(rows.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "stands")
    reps = rows.join(stands.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    each = reps.select("id", "n", "bits0", "bits1", F.explode("entries").alias("entry"))
    groups = each.groupBy("entry").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    each = materialise(each.join(groups, "entry"), "groups")
    # a group's hub is the member with most company over all its groups: the middle of a group of near copies
    company = each.groupBy("id").agg((-F.sum("size")).alias("company"))
    hubs = each.join(company, "id").groupBy("entry").agg(F.min(F.struct("company", "id", "n", "bits0", "bits1")).alias("hub"))
    member = materialise(each.drop("size").join(hubs, "entry"), "members")
    count = member.count()  # of pairs of a hub and a member there are no more
    texts = docs.select(F.col(doc_id).alias("id"), packed(text).alias("t"))
    texts = materialise(texts.join(member.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    first = member.where(F.col("hub.id") != F.col("id")).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    checked = materialise(verify(first, texts), "checked")
    links = checked.where("alike").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    part = materialise(components(links, "a", "b"), "part", count)
    star = member.select(F.col("hub.id").alias("hub"), "id", "n", "bits0", "bits1").distinct()
    sharing, common = _sharing(star, checked, part, count)
    found = materialise(verify(sharing, texts).where("alike").select("a", "b"), "sharing")
    links = materialise(links.union(found).distinct(), "links")
    part = materialise(extended(part, found), "part", count)
    more = _by_pivots(common, links, part, texts)
    if more is not links:
        links, part = more, extended(part, more)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    verdict = stands.join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    verdict = materialise(verdict.select("same", "copies", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "verdict")
    found = with_verdicts(rows.select(F.col("id").alias("id_of"), "same"), verdict, "same", "copies").select("id_of", "class_id", "n_links").distinct()
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    out = ids.join(found, ids["doc_id"].eqNullSafe(found["id_of"]), "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id stands for its class, with all their columns."""
    name = own_names(docs.columns, "gone")[0]
    gone = classes(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")


__all__ = ["alike", "classes", "drop_near", "sketches"]
