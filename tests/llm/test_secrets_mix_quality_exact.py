import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from orograph.llm import exact_dedup, mixing, quality, secrets
from orograph.llm.shared import scratch_dir

from .fixture import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def brute_spans(text, kinds):
    found = []
    for k, (kind, pattern, part, least, flags) in enumerate(kinds):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[part]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


BASE = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII),
        ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0)]


def test_secret_spans(spark, docs):
    ledger = scratch_dir(spark, "ledger")
    found = {r.doc_id: secrets_of(r.findings) for r in secrets.scan(docs, ledger).collect()}
    assert len(found) == len(rows())
    for doc_id, text, *_ in rows():
        assert [x for x in found[doc_id] if x.split(":")[0] in ("assign", "access", "hex")] == brute_spans(text, BASE), text
    assert any(x.startswith("github") for v in found.values() for x in v)


def secrets_of(findings):
    return [f"{x.kind}:{x.start}:{x.end}" for x in findings]


def test_ledger_scans_unseen_pairs_only(spark, docs):
    ledger = scratch_dir(spark, "ledger")
    first = secrets.scan(docs, ledger, secrets.BASE_RULES).collect()
    n = secrets.read_ledger(spark, ledger).count()
    assert n == docs.select("text").fillna("").distinct().count()
    again = secrets.scan(docs, ledger, secrets.BASE_RULES).collect()
    assert sorted(again) == sorted(first) and secrets.read_ledger(spark, ledger).count() == n
    newer = [*secrets.BASE_RULES[:2], secrets.Rule("hex", "[0-9a-f]{28,}", version=2)]
    third = secrets.scan(docs, ledger, newer)
    assert secrets.read_ledger(spark, ledger).where(F.array_contains("rules", "hex@2")).agg(F.max(F.size("rules"))).first()[0] == 1
    assert {x.kind for r in third.collect() for x in r.findings if x.end - x.start < 28} <= {"assign", "access"}
    extra = spark.createDataFrame([(5000, "token: 0123456789abcdef0123456789abcdef")], "doc_id long, text string")
    before = secrets.read_ledger(spark, ledger).count()
    assert secrets_of(secrets.scan(extra, ledger, newer).first().findings) == ["assign:0:39", "hex:7:39"]
    assert secrets.read_ledger(spark, ledger).count() == before + 1
    assert secrets.scan(extra.limit(0), ledger, newer).count() == 0


def test_water_fill_caps_and_reshares(spark):
    s = spark.createDataFrame([("a", 100, 5.0), ("b", 1000, 2.0), ("c", 10, 1.0), (None, 400, 5.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(s, 1.5, 2.0).collect()}
    assert got["a"] == 200 and got["c"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1510)
    assert all(got[k] <= 2 * v for k, v in (("b", 1000), (None, 400)))


def brute_mix(table):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in table}
    by = defaultdict(list)
    for r in table:
        by[r[3]].append(r[0])
    names = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[d] for d in by[s]) for s in names}
    full, left = set(), names
    while True:
        left = [s for s in names if s not in full]
        w = sum(weight[s] for s in left)
        level = (1.5 * sum(total.values()) - sum(2.0 * total[s] for s in full)) / w if w else 0.0
        more = {s for s in left if weight[s] * level > 2.0 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * total[s] if s in full else weight[s] * level for s in names}
    taken = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = int(target[s]) - whole * total[s]
        for d in sorted(by[s], key=lambda d: hashlib.md5(f"17:{d}".encode()).hexdigest()):
            taken[d] = whole * size[d] + max(0, min(rest, size[d]))
            rest -= size[d]
    return {r[0]: (size[r[0]], total[r[3]], target[r[3]], taken[r[0]]) for r in table}


def test_mix_matches_brute_force(docs):
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.decide(docs).collect()}
    assert got == brute_mix(rows())


def test_mix_rows_and_empty(spark, docs):
    decided = mixing.decide(docs)
    taken = mixing.take_rows(docs, decided)
    assert taken.columns == docs.columns
    times = Counter(r.doc_id for r in taken.collect())
    assert all(times[r.doc_id] == int(r.taken / r["size"] + 0.5) for r in decided.collect() if r["size"])
    assert mixing.decide(docs.limit(0)).count() == 0


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    symbols, upper, lower, bangs = (len(re.findall(p, text)) for p in (r"[#*$%&|<>]", "[A-Z]", "[a-z]", "!"))
    n, chars = len(w), sum(map(len, w))
    failed = n < 20 or 100 * len(cover) > 30 * n
    more = 10 * symbols > 3 * n or 2 * bangs > n or (upper > 20 and 2 * upper > 3 * lower) or 5 * dup > 2 * len(lines) or chars > 20 * n or chars < 2 * n
    return n, chars, symbols, dup, len(cover), failed, not (failed or more)


def test_quality_matches_brute_force(docs):
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[m] for m in base) + (r.kept,) for r in quality.judge(docs, measures=base).collect()}
    for doc_id, text, *_ in rows():
        want = brute_quality(text)
        assert got[doc_id] == want[:5] + want[6:], text and text[:80]


def test_quality_order_and_filter(docs):
    rules = quality.order_rules(docs)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)
    want = {r[0] for r in rows() if brute_quality(r[1])[6]}
    for order in (rules, rules[::-1]):
        kept = quality.filter_quality(docs, order)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert quality.filter_quality(docs.limit(0)).count() == 0


def test_cascade_stops_after_a_rejection():
    from orograph.llm import words

    asked = []
    rules = [quality.Rule("all", lambda b: b.get("n_words") >= 0), quality.Rule("never", lambda b: asked.append(1) or b.get("n_words") < 0)]
    import numpy as np

    kept, by = quality.cascade(quality.Batch(np.frombuffer(b"ab c", np.uint8), np.array([0, 2, 4])), rules)
    assert not kept.any() and list(by) == [0, 0] and not asked and words.RADIX % 2


def test_exact_dedup(spark, docs):
    got = {r.doc_id: r for r in exact_dedup.dedup_decisions(docs).collect()}
    groups = defaultdict(list)
    low = {i: (t or "").encode().lower() for i, t, *_ in rows()}
    for i, t in low.items():
        groups[t].append(i)
    for i, t in low.items():
        g = groups[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.dedup_decisions(docs.limit(0)).count() == 0
    twice = exact_dedup.drop_copies(docs.union(docs))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_state_goes_on(spark, docs):
    folder = scratch_dir(spark, "state")
    first = docs.where("doc_id % 2 = 0")
    exact_dedup.dedup_decisions(first, folder=folder).count()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_decisions(docs.where("doc_id % 2 = 1"), folder=folder).collect()}
    whole = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_decisions(docs).collect()}
    assert got == {k: v for k, v in whole.items() if k % 2}


@F.arrow_udf(BinaryType())
def first_letter(text: pa.Array) -> pa.Array:
    """A digest that different texts share."""
    return pa.array([(x or b"")[:1].lower() for x in text.cast(pa.binary()).to_pylist()], pa.binary())


def test_texts_of_one_digest_are_told_apart(spark):
    table = [(1, "xa"), (2, "XA"), (3, "xb"), (4, "y"), (5, "xb"), (6, "Y"), (7, None)]
    got = exact_dedup.dedup_decisions(spark.createDataFrame(table, "doc_id long, text string"), digest=first_letter)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == {
        1: (2, 2, False), 2: (2, 2, True), 3: (5, 2, False), 5: (5, 2, True), 4: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}


def test_keepers_of_an_earlier_run_are_read_by_locator(spark):
    folder = scratch_dir(spark, "state")
    early = spark.createDataFrame([(9, "same", "f1"), (8, "xb", "f1")], "doc_id long, text string, at string")
    exact_dedup.dedup_decisions(early, locator=F.col("at"), folder=folder, digest=first_letter).count()
    late = spark.createDataFrame([(1, "SAME", "f2"), (2, "xc", "f2")], "doc_id long, text string, at string")
    seen = early.withColumnRenamed("at", "locator")
    got = {r.doc_id: (r.keep_id, r.keep_locator, r.kept) for r in exact_dedup.dedup_decisions(late, locator=F.col("at"), folder=folder, contents=seen, digest=first_letter).collect()}
    assert got == {1: (9, "f1", False), 2: (2, "f2", True)}
