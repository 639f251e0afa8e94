"""Scores of a word bigram model held in Elias-Fano tries that are dealt over the cluster.

Tokens are words (A-Z lower-cased) and one end for each text. The model's probability of a word w after v (the text's
beginning counts as a word) is ``(c(v w) + MU * P(w)) / (c(v) + MU)`` with ``P(w) = (c(w) + 1) / (N + V + 1)``: Dirichlet
smoothing, which sums to 1 over all known words and one unknown one. Its logarithm is a term of the pair and w, less one of v alone. The
trie of a shard holds the pairs by the word that is predicted: level 1 has the shard's words and the term of an unseen pair, level 2 below each word
the words seen before it and their terms, all quantised to 16 bits.

Neither counts nor model pass through the driver. A task turns a block of texts into packs, one for each shard: distinct words (or
pairs) with their training counts and the documents that hold them. A shard adds up its packs' counts, builds its level or trie, looks
every pack up, and answers with one partial sum for each document of a pack; the sums of a block meet again by block. A first
pass does this for words (counts, the base score, the terms of v), a second for pairs. Words that are more than a quarter of a
shard's fair share (at most four times as many as shards) are dealt by v instead of w.

A shard has about ``SHARD_BYTES`` of text at most, so there are more shards than tasks where the corpus asks for it, and a task holds
one at a time; its trie lies in one memory map.

Words are known by 63 bits of a hash (of a digest, if they are long), those before a word by 40. Defined results: a null text is empty and has the end alone. Rows are known by
numbers of their own: each repeated row is scored, ids may be of any type, repeated or null. With nothing to learn from, every word is unknown.
An empty table gives no rows. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .elias_fano import Trie
from .shared import materialise
from .suffix_dedup import dump, load

U = np.uint64
MU = 200.0
BLOCK, CHUNK, SHARD_BYTES = 12 << 20, 1 << 19, 64 << 20
END, BEGIN = U(0x5BD1E995A3C59AC3 >> 1), U(0x27D4EB2F165667C5 >> 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of all tokens in the order of the texts, each text's end last."""
    data = W.LOWER[data]
    start, end, row = W.words(data, offsets)
    ids = W.word_hashes(data, start, end) >> U(1)
    n = len(offsets) - 1
    at = np.concatenate([row, np.arange(n)])
    order = np.argsort(at, kind="stable")
    return np.concatenate([ids, np.full(n, END)])[order], at[order]


def before(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The id that stands before each token."""
    out = np.empty_like(ids)
    if len(ids):
        out[1:] = ids[:-1]
        out[np.append(True, row[1:] != row[:-1])] = BEGIN
    return out


def short(ids: np.ndarray) -> np.ndarray:
    return ids >> U(63 - Trie.CHILD)


def blocks(batches, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, train flags, tokens, their rows and the ids before them, for about ``most`` bytes of text."""
    held, size, n = [], 0, 0
    for part, data, offsets in W.chunks(batches, "text", CHUNK):
        ids, row = tokens(data, offsets)
        held.append((part.column(0).to_numpy(zero_copy_only=False), np.array(part.column(1).to_pylist(), bool), ids, row + n, before(ids, row)))
        size += len(data)
        n += len(offsets) - 1
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size, n = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def pack(doc, train, row, shard, word, child=None):
    """(shard, payload) rows: words, sizes and children (if asked for), training counts, the number of documents of each item,
    and the documents (as places in the pack's list of ids) with how often they hold it."""
    order = np.argsort(word, kind="stable") if child is None else np.lexsort((child, word))
    order = order[np.argsort(shard[order].astype(np.uint32), kind="stable")]
    word, row, shard = word[order], row[order], shard[order]
    child = None if child is None else child[order]
    new = np.append(True, word[1:] != word[:-1])
    if child is not None:
        new[1:] |= child[1:] != child[:-1]
        new[1:] |= shard[1:] != shard[:-1]
    hold = new.copy()
    hold[1:] |= row[1:] != row[:-1]
    item, occurrence = np.flatnonzero(new), np.flatnonzero(hold)
    learned = np.add.reduceat(train[row].astype(np.int64), item)
    times = np.diff(np.append(occurrence, len(word)))
    per_item = np.diff(np.append(np.searchsorted(occurrence, item), len(occurrence)))
    of_item, of_row = shard[item], row[occurrence]
    cut_item, cut_occurrence = np.flatnonzero(np.append(True, of_item[1:] != of_item[:-1])), None
    cut_occurrence = np.append((np.cumsum(per_item) - per_item)[cut_item], len(occurrence))
    cut_item = np.append(cut_item, len(item))
    for k in range(len(cut_item) - 1):
        i, o = slice(cut_item[k], cut_item[k + 1]), slice(cut_occurrence[k], cut_occurrence[k + 1])
        rows, place = np.unique(of_row[o], return_inverse=True)
        w = word[item[i]]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        head = [w[first], np.diff(np.append(first, len(w))).astype(np.uint32), np.zeros(0, np.uint8)]
        if child is not None:
            head[2] = np.ascontiguousarray(child[item[i]].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : Trie.CHILD // 8].reshape(-1)
        yield int(of_item[cut_item[k]]), dump(*head, learned[i].astype(np.uint32), per_item[i].astype(np.uint32), place.astype(np.uint16 if len(rows) < 65536 else np.uint32), times[o].astype(np.uint32), doc[rows])


def children(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // (Trie.CHILD // 8), 8), np.uint8)
    out[:, : Trie.CHILD // 8] = raw.reshape(len(out), Trie.CHILD // 8)
    return out.view("<u8").reshape(-1).astype(U)


def per_document(p: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sums over a pack's documents of a value of each item times how often they hold it."""
    return np.bincount(p[5], np.repeat(values, p[4]) * p[6], len(p[7]))


def packs(docs: DataFrame, tasks: int, shards: int, pairs: bool, hot: np.ndarray) -> DataFrame:
    def run(batches):
        for k, (doc, train, ids, row, prior) in enumerate(blocks(batches)):
            block = (TaskContext.get().partitionId() << 20) + k
            if pairs:
                child = short(prior)
                shard = np.where(np.isin(ids, hot), child, ids) % U(shards)
                rows = list(pack(doc, train, row, shard, ids, child))
            else:
                rows = list(pack(doc, train, row, ids % U(shards), ids))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["shard", "block", "payload"])

    return docs.mapInArrow(run, "shard int, block long, payload binary").repartition(tasks, "shard").sortWithinPartitions("shard", "block")


def by_shard(batches) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The packs of one shard at a time, still compressed."""
    shard, held = None, []
    for batch in batches:
        for s, b, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != shard and held:
                yield shard, [x[0] for x in held], [x[1] for x in held]
                held = []
            shard = s
            held.append((b, value))
    if held:
        yield shard, [x[0] for x in held], [x[1] for x in held]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[edge], np.add.reduceat(counts.astype(np.int64), edge) if len(edge) else counts.astype(np.int64)


def word_level(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of training and their counts."""
    parts = [load(v) for v in values]
    keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[3] for p in parts]))
    return keys[counts > 0], counts[counts > 0]


def pair_trie(values: list[bytes], total: int, distinct: int, hot: np.ndarray, hot_counts: np.ndarray) -> Trie:
    """A shard's trie from the training counts of its packs."""
    word, child, count = [], [], []
    for v in values:
        p = load(v)
        keep = p[3] > 0
        word.append(np.repeat(p[0], p[1])[keep])
        child.append(children(p[2])[keep])
        count.append(p[3][keep])
    word, child, count = (np.concatenate(x) for x in (word, child, count))
    order = np.lexsort((child, word))
    word, child, count = word[order], child[order], count[order]
    edge = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (child[1:] != child[:-1]))[: len(word)])
    count = np.add.reduceat(count.astype(np.int64), edge) if len(edge) else count.astype(np.int64)
    word, child = word[edge], child[edge]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
    words, sizes = word[first], np.diff(np.append(first, len(word)))
    of_word = np.add.reduceat(count, first) if len(first) else count
    if len(hot) and len(words):
        i = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        of_word = np.where(hot[i] == words, hot_counts[i], of_word)
    prior = MU * (of_word + 1) / (total + distinct + 1)
    return Trie.build(words, sizes, child, np.log10(prior), np.log10(count + np.repeat(prior, sizes)), float(np.log10(MU / (total + distinct + 1))))


def _answers(docs: DataFrame, n: int) -> DataFrame:
    """Sums of the answers (block, payload of row numbers and n value arrays) by row."""
    names = [f"v{i}" for i in range(n)]

    def run(batches):
        held, size = [], 0

        def flush():
            ids = np.concatenate([p[0] for p in held])
            keys, place = np.unique(ids, return_inverse=True)
            sums = [np.bincount(place, np.concatenate([p[1 + i] for p in held]), len(keys)) for i in range(n)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(s, pa.float64()) for s in sums)], ["row", *names])

        for batch in batches:
            for value in batch.column(1):
                held.append(load(value.as_py()))
                size += len(held[-1][0])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "row long, " + ", ".join(f"{x} double" for x in names)).groupBy("row").agg(*(F.sum(x).alias(x) for x in names))


def _source(docs: DataFrame, learn, doc_id: str, text: str) -> tuple[DataFrame, int, int]:
    """Rows with a number each, written so that both passes see the same, and how many tasks and shards they ask for."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    rows = materialise(rows, "lm-rows")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, tasks, max(tasks, -(-size // SHARD_BYTES))


def word_pass(source: DataFrame, tasks: int, shards: int):
    """Answers of the first pass, the numbers of training tokens and words, and the hot words with their counts."""

    def run(batches):
        for shard, block, values in by_shard(batches):
            keys, counts = word_level(values)
            many = np.flatnonzero(counts > counts.sum() / 1024) if len(counts) else np.zeros(0, int)
            yield row(shard, -1, dump(np.array([counts.sum(), len(counts)], np.int64), keys[many], counts[many]))
            for b, v in zip(block, values, strict=True):
                p = load(v)
                i = np.minimum(np.searchsorted(keys, p[0]), max(0, len(keys) - 1))
                c = np.where(keys[i] == p[0], counts[i], 0) if len(keys) else np.zeros(len(p[0]), np.int64)
                sums = [per_document(p, x) for x in (np.ones(len(c)), c > 0, np.log10(c + 1.0), np.log10(c + MU))]
                yield row(shard, b, dump(p[7], sums[0].astype(np.uint32), sums[1].astype(np.uint32), sums[2], sums[3]))

    def row(shard, b, value):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b], pa.int64()), pa.array([value], pa.binary())], ["shard", "block", "payload"])

    def often(batches):
        for batch in batches:
            for value in batch.column(0):
                (n, v), keys, counts = load(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v]), pa.array([keys.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], ["n", "v", "words", "counts"])

    plain = source.select("row", "train", "text")
    out = materialise(packs(plain, tasks, shards, False, np.zeros(0, U)).mapInArrow(run, "shard int, block long, payload binary"), "lm-words")
    per_shard = materialise(out.where("block < 0").select("payload").mapInArrow(often, "n long, v long, words array<long>, counts array<long>"), "lm-shards")
    total, distinct = (x or 0 for x in per_shard.agg(F.sum("n"), F.sum("v")).first())
    # fewer than four times as many as there are shards
    hot = per_shard.select(F.explode(F.arrays_zip("words", "counts")).alias("z")).select("z.*").where(F.col("counts") * (4 * shards) > total).collect()
    hot = sorted((int(np.int64(r[0]).view(U)), r[1]) for r in hot)
    return out.where("block >= 0").select("block", "payload"), total, distinct, np.array([k for k, _ in hot], U), np.array([c for _, c in hot], np.int64)


def train(docs: DataFrame, learn=None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """The pair tries as rows ``shard, trie`` (write them where they are to stay), and what scoring needs beside them."""
    source, tasks, shards = _source(docs, F.lit(True) if learn is None else learn, doc_id, text)
    source = source.where("train")
    _, total, distinct, hot, hot_counts = word_pass(source, tasks, shards)

    def run(batches):
        for shard, _, values in by_shard(batches):
            trie = pair_trie(values, total, distinct, hot, hot_counts).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([trie], pa.binary())], ["shard", "trie"])

    tries = packs(source.select("row", "train", "text"), tasks, shards, True, hot).mapInArrow(run, "shard int, trie binary")
    return tries, {"shards": shards, "total": total, "distinct": distinct, "hot": hot}


def score(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; the model learns from the rows where ``learn`` is
    true. base_score: the add-one unigram model's log10 probability; score: the pair model's."""
    source, tasks, shards = _source(docs, learn, doc_id, text)
    first, total, distinct, hot, hot_counts = word_pass(source, tasks, shards)

    def run(batches):
        for _, block, values in by_shard(batches):
            trie = pair_trie(values, total, distinct, hot, hot_counts).mapped()
            for b, v in zip(block, values, strict=True):
                p = load(v)
                found = dump(p[7], per_document(p, trie.lookup(p[0], p[1], children(p[2]))))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([found], pa.binary())], ["block", "payload"])

    second = materialise(packs(source.select("row", "train", "text"), tasks, shards, True, hot).mapInArrow(run, "block long, payload binary"), "lm-pairs")
    words = _answers(first.repartition(tasks, "block"), 4).select("row", *(F.col(f"v{i}").alias(x) for i, x in enumerate(("n", "known", "base", "prior"))))
    pairs = _answers(second.repartition(tasks, "block"), 1).withColumnRenamed("v0", "pair")
    scores = words.join(pairs, "row").select(
        "row", F.col("n").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("pair") - F.col("prior")).alias("score"))
    return source.select("row", "doc_id").join(scores, "row", "left").drop("row")
