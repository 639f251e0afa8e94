import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import periodic, queries, top_k, whitening

VECTORS = "vec_id long, embedding array<float>, label int, id long, row string, x int, asks int, component int"


def vectors(spark, n=300, dims=12, seed=3):
    """Random vectors with copies, and every kind that takes no part."""
    r = random.Random(seed)
    some = [[r.gauss(0, 0.2) * (3 if j < 2 else 1) for j in range(dims)] for _ in range(n)]
    for i in range(0, n, 3):
        some[i] = some[0]  # a third of all rows
    odd = [None, [], [None] + [0.1] * (dims - 1), [math.nan] + [0.1] * (dims - 1), [math.inf] + [0.1] * (dims - 1), [0.5] * (dims - 1), [1e30] * dims]
    rows = [(i, v, 0, 1, "r", 2, 3, 4) for i, v in enumerate(some + odd)]
    rows += [(None, some[1], 0, 1, "r", 2, 3, 4), (20, some[2], 0, 1, "r", 2, 3, 4)]
    return spark.createDataFrame(rows, VECTORS), [(i, v) for i, v in enumerate(some)] + [(None, some[1]), (20, some[2])]


def brute_top(rows, k, scale=64):
    # single precision, as the table has it
    x = [[math.floor(scale * float(np.float32(c))) for c in v] for _, v in rows]
    out = []
    for a, (q, _) in enumerate(rows):
        if q is None or q % 20:
            continue
        scores = sorted((-sum(s * t for s, t in zip(x[a], x[b], strict=True)), rows[b][0] is None, rows[b][0] or 0, b) for b in range(len(rows)) if b != a)
        out += [(q, rank, rows[s[3]][0], -s[0]) for rank, s in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [5, 400])
def test_top_k_equals_brute_force(spark, monkeypatch, k):
    for name, value in (("CANDIDATES", 90), ("FEW", 40), ("GROUPS", 3), ("QUERIES", 7), ("TILE", (4, 16)), ("WIDTH", 5)):
        monkeypatch.setattr(top_k, name, value)
    df, rows = vectors(spark)
    got = top_k.search(df, F.col("vec_id") % 20 == 0, k=k, pilot=50)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, k)


def test_top_k_without_rows_or_queries(spark):
    df, _ = vectors(spark, 30)
    assert top_k.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k.search(df, F.lit(None).cast("boolean")).count() == 0
    assert top_k.search(df.where("vec_id = 20"), F.lit(True)).count() == 2  # the two rows with the id 20 answer each other
    named = df.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert top_k.search(named, F.col("vec_id") == "v3", k=2).first()["query_id"] == "v3"


def test_bounds_keep_all_that_reach_the_threshold():
    r = np.random.default_rng(1)
    for kind in (np.float64, np.int64):
        c, q = r.integers(-30, 30, (500, 20)), r.integers(-30, 30, (40, 20))
        c[100:200] = c[7]
        order = np.argsort(-(c * c).sum(0))
        i, j, s = top_k.best(q, np.arange(1000, 1040), c, np.arange(500), order, 9, kind, np.full(40, -np.inf))
        full = q @ c.T
        for a in range(40):
            want = sorted(((-full[a, b], b) for b in range(500)))[:9]
            assert [(-int(x), int(y)) for x, y in zip(s[i == a], j[i == a], strict=True)] == [(int(x), int(y)) for x, y in want]


def brute_white(rows, k):
    v = np.array([np.floor(1024 * np.float32(x).astype(np.float64)) + 100000 for _, x in rows])
    n, mean = len(v), v.mean(0)
    values, turn = np.linalg.eigh((v - mean).T @ (v - mean) / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return v, values, (v - mean) @ turn / np.sqrt(values), ((n * v.astype(object) - v.astype(object).sum(0)) ** 2).sum(1)


@pytest.mark.parametrize("block", [2, 4])
def test_whitening_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "PACKED", 100)
    monkeypatch.setattr(whitening, "BLOCK", block)
    df, rows = vectors(spark, 200)
    got = whitening.whiten(df, k=3)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    v, values, white, deviation = brute_white(rows, 3)
    table = {}
    for r in got.collect():
        table.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    sign = {}
    for (i, _), w, d in zip(rows, white, deviation, strict=True):
        for c in range(3):
            r = table[i, int(d)][c + 1]
            assert r["n"] == len(rows) and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(values[c] / ((v - v.mean(0)) ** 2).mean(0).sum(), rel=1e-9)
            s = sign.setdefault(c, 1 if r["whitened"] * w[c] > 0 else -1)
            assert r["whitened"] * s == pytest.approx(w[c], abs=1e-8)


def test_whitening_without_rows_or_variance(spark):
    df, rows = vectors(spark, 30)
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.where("vec_id = 3"), k=2).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "s") for i in range(9)], "vec_id int, embedding array<double>, s string")
    got = whitening.whiten(flat, k=8).collect()
    assert len(got) == 27 and {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert sum(r["whitened"] ** 2 for r in got if r["component"] == 1) == pytest.approx(9)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[2**40], [-(2**40)], [5]])
    assert whitening.deviations(x, 3, x.sum(0)) == [None, None, (3 * 5 - 5) ** 2]


def brute_runs(s, least_length=2, least_exponent=2):
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            b = i
            while i + q < n and s[i] == s[i + q]:
                i += 1
            if i - b + q >= max(least_exponent * q, 2 * q, least_length) and i > b:
                found.setdefault((b, i - b + q), q)
            i += i == b
    return sorted((a, n, q) for (a, n), q in found.items())


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        n = r.randint(0, 40)
        s = [r.randint(0, r.choice([0, 1, 1, 2, 3])) for _ in range(n)]
        if n and r.random() < 0.5:
            p = r.randint(1, max(1, n // 3))
            s = [s[i % p] for i in range(n)]
            for _ in range(r.randint(0, 2)):
                s[r.randrange(n)] ^= 1
        after, agree = periodic.lyndon(s)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
            k = 0
            while j + k < n and s[i + k] == s[j + k]:
                k += 1
            assert (after[i], agree[i]) == (j, k)
        assert periodic.runs(s) == brute_runs(s)
        assert periodic.runs(s, 6, 3) == brute_runs(s, 6, 3)


def test_runs_take_linear_work():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20000:
        fib.append(fib[-1] + fib[-2])
    n = 20000
    for s in ([0] * n, fib[-1], [bin(i).count("1") & 1 for i in range(n)], ([0] * 140 + [1]) * 140, list(range(n)), list(range(n))[::-1], [0, 1, 2] * (n // 3), [x for k in range(1, 200) for x in [0] * k + [1]], [x for k in range(200, 0, -1) for x in [0] * k + [1]]):
        work = [0]
        periodic.runs(s, 2, 2, work)
        assert work[0] < 14 * len(s)


def brute_row(words):
    found = brute_runs(words, 24, 3)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(9)] + ["é", "😀"]
    out = [None, "", " \n\t", "a", "well " * 100, "a b " * 12, "a b " * 11 + "a", "a b " * 30]
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        p, a = r.randint(1, 9), r.randint(0, 30)
        words[a:] = (words[a : a + p] * 40)[: max(0, len(words) - a)]
        words += [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        out.append(r.choice([" ", "\n", " \t"]).join(words))
    inner = "a a a a a a a a a a b " * 10
    return [*out, inner * 3, "x " + inner + "y " + inner, "p q r " * 20000, out[20], out[20]]


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_find_runs_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 500)
    rows = [(None if i == 20 else i % 60, t, "c", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, __id int")
    got = periodic.find_runs(df, keep=("doc_id", "text", "runs"))
    assert got.columns == ["doc_id", "text", "runs", "runs", "collapsed"]
    seen = sorted(((r[0], r[1], [tuple(x) for x in r[3]], r[4]) for r in got.collect()), key=repr)
    assert seen == sorted(((i, t, *((brute_row(split(t))) if t is None or len(t) < 9999 else ([(0, 60000, 3)], "p q r"))) for i, t, _, _ in rows), key=repr)
    assert periodic.find_runs(df.limit(0)).count() == 0
    digest = periodic.find_runs(df.where("doc_id = 5"), with_text=False).first()
    assert digest["collapsed_sha256"] == __import__("hashlib").sha256(b"a b").hexdigest()


def test_pieces_hold_every_run():
    r = random.Random(4)
    for _ in range(300):
        docs = [[r.randint(0, 6) for _ in range(r.randint(0, 80))] for _ in range(4)]
        for d in docs:
            if d and r.random() < 0.7:
                p = r.randint(1, 8)
                d[len(d) // 3 :] = (d[:p] * 80)[: len(d) - len(d) // 3]
        words = [[str(x).encode() for x in d] for d in docs]
        assert periodic._runs_of(words, 24, 3) == [brute_runs(d, 24, 3) for d in docs]


def test_query_of_runs(spark, tmp_path):
    rows = [(i * 7 if i else None, t) for i, t in enumerate(texts()) if t is None or len(t) < 9999]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    for i, t in rows:
        words = [w.decode() for w in queries.with_period(i, (t or "").encode().split())]
        found, left = brute_row(words)
        top = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        want = (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(left))
        assert tuple(got[i])[1:] == want
