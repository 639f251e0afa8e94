import hashlib
import math
import mmap
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import lm, suffix_dedup
from orograph.llm.elias_fano import EliasFano, Trie

from .fixture import frame, rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def brute_removed(table, length):
    first = {}
    for i, t in table:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in table:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        out[i] = gone
    return out


def test_suffix_dedup_matches_brute_force(docs):
    table = [(i, (t or "").encode()) for i, t, *_ in rows()]
    want = brute_removed(table, 50)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs).collect()}
    assert sum(w.any() for w in want.values()) > 5
    for i, t in table:
        kept = bytes(np.frombuffer(t, np.uint8)[~want[i]])
        runs = int(np.diff(np.concatenate([[0], want[i].astype(int)])).clip(0).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(want[i].sum()), runs, hashlib.sha256(kept).hexdigest())
        assert bytes(got[i].kept) == kept


def test_suffix_dedup_null_ids_and_empty(spark, docs):
    t = "abcdefghij" * 7
    table = spark.createDataFrame([(None, t), (3, t), (None, t), (5, t)], "doc_id long, text string")
    got = suffix_dedup.cut_repeats(table).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 0), (0, 0), (3, 0), (5, 70)]
    assert suffix_dedup.cut_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("trial", range(25))
def test_buckets_match_brute_force(trial):
    r = random.Random(trial)
    alphabet, length = r.choice([b"ab", b"abcdefghij", b"a", bytes(range(97, 123))]), r.choice([50, 20])
    base = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(4)]

    def piece():
        x = r.choice(base)
        return x[r.randint(0, len(x) // 2) : r.randint(len(x) // 2, len(x))] if r.random() < 0.7 else bytes(r.choice(alphabet) for _ in range(r.randint(0, 80)))

    texts = [(i * 3, b"".join(piece() for _ in range(r.randint(0, 4)))) for i in range(r.randint(1, 14))]
    r.shuffle(texts)
    want, sent = brute_removed(texts, length), defaultdict(list)
    for half in (texts[: len(texts) // 2], texts[len(texts) // 2 :]):
        block = suffix_dedup.Block(3, length)
        for part in (half[:3], half[3:]):
            if part:
                block.add(np.array([i for i, _ in part]), np.frombuffer(b"".join(t for _, t in part), np.uint8), np.cumsum([0] + [len(t) for _, t in part]))
        for b, payload in block.send():
            sent[b].append(suffix_dedup.load(payload))
    got = {i: np.zeros(len(t), bool) for i, t in texts}
    for payloads in sent.values():
        for doc, a, b in zip(*suffix_dedup.bucket_removals(payloads, length), strict=True):
            got[int(doc)][a:b] = True
    assert all((got[i] == want[i]).all() for i, _ in texts)


@pytest.mark.parametrize("length", [60, 128, 150, 300, 1000])
def test_long_strings(spark, length):
    r = random.Random(length)
    common = "".join(r.choice("abcdefgh") for _ in range(1500))
    table = [(i, "".join(r.choice("abcdefgh") for _ in range(200)) + common[i : 1500 - i] + "xyz") for i in range(6)]
    want = brute_removed([(i, t.encode()) for i, t in table], length)
    for buckets in (1 << 30, 500):
        spans = suffix_dedup.repeated_spans(spark.createDataFrame(table, "doc_id long, text string"), length, bucket_bytes=buckets)
        gone = {i: np.zeros(len(t), bool) for i, t in table}
        for x in spans.collect():
            for a, n in zip(*suffix_dedup.load(bytes(x.found)), strict=True):
                gone[x.doc_id][a : a + n] = True
        assert all((gone[i] == want[i]).all() for i in gone)


def test_string_ids_in_their_order(spark):
    t = "abcdefghij" * 7
    table = spark.createDataFrame([("b", t, 1), (None, t, 2), ("a", t, 3), ("c", "x" + t, 4)], "doc_id string, text string, number_of long")
    got = suffix_dedup.cut_repeats(table).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or "", r[1]) for r in got) == [("", 0), ("a", 0), ("b", 70), ("c", 70)]


def test_spans_of_very_many_documents():
    doc = np.repeat(np.arange(9_000_000), 2)
    start = np.tile(np.array([5, 1000]), 9_000_000)
    a, b, d = suffix_dedup.joined(start, start + 60, doc)
    assert len(a) == len(doc) and (b - a == 60).all() and (d == doc).all()
    a, b, d = suffix_dedup.joined(np.tile(np.array([5, 50]), 9_000_000), start + 60, doc)
    assert len(a) == 9_000_000 and (a == 5).all() and (b == 1060).all()


def test_minimisers_of_very_many_buckets():
    r = np.random.default_rng(5)
    least = np.unique(r.integers(0, 1 << 63, 20_000, np.uint64) << np.uint64(1))
    sent = defaultdict(list)
    for doc in (1, 2):
        for b, payload in suffix_dedup.send_minimisers(np.full(len(least), doc), least, 200_000):
            sent[b].append(suffix_dedup.load(payload))
    assert sum(len(suffix_dedup.shared_minimisers(p)[0]) for p in sent.values()) == 2 * len(least)


def test_minimisers_alike_in_high_bits_reach_their_buckets():
    """Of three minimisers of a block that differ in the low bits only, each meets its like of another block in its own bucket."""
    r = np.random.default_rng(2)
    near = (r.integers(0, 1 << 40, 60).astype(np.uint64) << np.uint64(20))[:, None] + np.arange(3, dtype=np.uint64)
    alone = near[np.arange(60), np.arange(60) % 3]
    sent = defaultdict(list)
    for doc, least in ((np.full(near.size, 7), near.reshape(-1)), (np.arange(100, 160), alone)):
        for b, payload in suffix_dedup.send_minimisers(doc, least, 3):
            sent[b].append(suffix_dedup.load(payload))
    got = {x for p in sent.values() for x in zip(*(v.tolist() for v in suffix_dedup.shared_minimisers(p)), strict=True)}
    high = (alone >> np.uint64(suffix_dedup.SHORT)).tolist()
    assert got == {(7, h) for h in high} | set(zip(range(100, 160), high, strict=True))


def test_transform_sorts_suffixes():
    r = random.Random(0)
    for _ in range(200):
        parts = [bytes(r.choice(b"ab\xff") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))]
        size = np.array([len(x) for x in parts])
        who, length, common = suffix_dedup.column_wise(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
        found = [parts[w][len(parts[w]) - n :] for w, n in zip(who, length, strict=True)]
        assert found == sorted(found) and len(found) == size.sum() + len(parts)
        for a, b, n in zip(found, found[1:], common[1:], strict=False):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (1, 2**60), (500, 600), (1000, 2**40), (3000, 2**63 - 1), (2000, 2000)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, universe, n, np.uint64))
    e = EliasFano.of(values)
    assert (e.get(np.arange(n)) == values).all()
    x = np.concatenate([values, values + np.uint64(1), r.integers(0, universe, 300, np.uint64), np.array([0, 2**63], np.uint64)])
    lo = r.integers(0, n + 1, len(x))
    hi = np.minimum(n, lo + r.integers(0, n + 1, len(x)))
    at, found = e.successor(x, lo, hi)
    want = np.clip(np.searchsorted(values, x, "left"), lo, hi)
    ok = want < hi
    hit = np.zeros(len(x), bool)
    hit[ok] = values[want[ok]] == x[ok]
    assert (found == hit).all() and (at[found] == want[found]).all()
    assert (at == want).all()
    if n == 1000:
        assert sum(a.nbytes for a in e.arrays()) < n * 8 * 0.7


def test_trie_in_a_mapped_file(tmp_path):
    r = random.Random(1)
    pairs = {(r.randrange(2**63), 0): 1 for _ in range(300)}
    table = {w: sorted({r.randrange(2**40) for _ in range(r.randint(1, 9))}) for w, _ in pairs}
    words = np.array(sorted(table), np.uint64)
    sizes = np.array([len(table[w]) for w in words.tolist()])
    child = np.array([v for w in words.tolist() for v in table[w]], np.uint64)
    log1, log2 = -np.arange(len(words)) / 100 - 1, -np.arange(len(child)) / 1000
    (tmp_path / "trie").write_bytes(Trie.build(words, sizes, child, log1, log2, -9.0).to_bytes())
    with open(tmp_path / "trie", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        t = Trie.from_buffer(m)
        assert np.allclose(t.lookup(words, sizes, child), log2, atol=1e-4)
        assert np.allclose(t.lookup(words, np.ones(len(words), int), child[np.cumsum(sizes) - 1] ^ np.uint64(1)), log1, atol=1e-4)
        assert np.allclose(t.lookup(words + np.uint64(1), np.ones(len(words), int), child[: len(words)]), -9.0)
        del t


def brute_scores(table, learn):
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in table}
    c, pair, ctx = Counter(), Counter(), Counter()
    for i, t in toks.items():
        if learn(i):
            c.update(t)
            pair.update(zip([b"", *t], t, strict=False))
            ctx.update([b"", *t[:-1]])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in toks.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        model = sum(math.log10((pair[a, w] + lm.MU * (c[w] + 1) / (n + v + 1)) / (ctx[a] + lm.MU)) for a, w in zip([b"", *t], t, strict=False))
        out[i] = (len(t), sum(c[w] > 0 for w in t), n, base, model)
    return out


@pytest.mark.parametrize("share", [2, 10**6])
def test_scores_match_brute_force(docs, share):
    """With and without held-out rows; "well" and others are hot words of so small a table."""
    table = [(i, t) for i, t, *_ in rows()]
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % share != 0).collect()}
    for i, want in brute_scores(table, lambda i: i % share != 0).items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=2e-4, abs=2e-3)


def test_model_probabilities_sum_to_one(docs):
    table = [(i, t) for i, t, *_ in rows()]
    vocabulary = {w for _, t in table for w in [*(t or "").encode().lower().split(), None]}
    c = Counter(w for _, t in table for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(vocabulary)
    after = Counter(b for _, t in table for a, b in zip((t or "").encode().lower().split(), [*(t or "").encode().lower().split()[1:], None], strict=False) if a == b"well")
    seen = sum(after.values())
    total = sum((after[w] + lm.MU * (c[w] + 1) / (n + v + 1)) / (seen + lm.MU) for w in vocabulary) + lm.MU / (n + v + 1) / (seen + lm.MU)
    assert total == pytest.approx(1)


def test_training_gives_tries(docs):
    tries, about = lm.train(docs)
    found = [Trie.from_buffer(bytes(r.trie)) for r in tries.collect()]
    table = [(i, t) for i, t, *_ in rows()]
    words = {w for _, t in table for w in [*(t or "").encode().lower().split(), None]}
    assert about["distinct"] == len(words) and sum(t.words.n for t in found) >= len(words)


def test_lm_empty_nulls_and_nothing_learned(spark, docs):
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    r = lm.score(docs.limit(3), F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and x.base_score == 0 for x in r)
    t = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.score(t, F.lit(True)).collect()}
    assert got[None].n_tokens == 3 and got[None].score < 0 and got[1].n_tokens == 1


def test_lm_repeated_rows_and_other_ids(spark):
    table = [("b", "x y z"), ("a", "x y"), ("a", "x y"), (None, "y y"), (None, "y y")]
    got = lm.score(spark.createDataFrame(table, "doc_id string, text string"), F.lit(True)).collect()
    want = brute_scores([(i, t) for i, (_, t) in enumerate(table)], lambda i: True)
    assert sorted((r.doc_id or "", r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((table[i][0] or "", w[0], w[1], round(w[3], 6)) for i, w in want.items())


def test_more_shards_than_tasks(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 2000)
    got = {r.doc_id: r for r in lm.score(docs, F.lit(True)).collect()}
    for i, want in brute_scores([(i, t) for i, t, *_ in rows()], lambda i: True).items():
        assert got[i].n_tokens == want[0] and got[i].score == pytest.approx(want[4], rel=2e-4, abs=2e-3)
