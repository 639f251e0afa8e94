"""All operators on documents over one awkward table and over an empty one: nulls in any column, empty and very long texts, ties, repeated rows, ids
that aren't numbers, and extra columns that are called like columns of the operators' own."""

import random
import resource
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import bpe, exact_dedup, language, line_dedup, lm, mixing, near_dedup, periodic, quality, secrets, suffix_dedup
from orograph.llm.graph import components
from orograph.llm.shared import ARROW, packed, scratch_dir

from .test_near_lines_language_bpe import brute_classes

EXTRA = ("id", "key", "n", "rep", "same", "gone", "removed", "copy_of", "times_of", "id_of", "__id", "__sha", "__times", "__copy", "__text", "digest", "row", "train", "found",
         "number", "number_of", "text_of", "kept", "kept_id", "size", "label", "blob", "copy", "t", "locator", "component", "taken", "cell", "hub", "entry")
LONG = " ".join(random.Random(4).choices([f"w{i}" for i in range(5000)], k=60_000))
TABLE = [("b", "one two three four five six. seven\nline\n", "en", "s"), ("a", "one two three four five six. seven\nline\n", "en", None), (None, "one two", None, "s"), (None, None, None, None),
         ("c", None, "fr", "s"), ("d", "", "fr", "s"), ("e", LONG, "en", "r"), ("f", LONG + " tail", "en", "r"), ("g", "x", None, "q"), ("g", "x", None, "q"), ("é", " \t\n", "en", "q")]
SCHEMA = "doc_id string, text string, lang string, source string"


def awkward(spark, rows=TABLE):
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(f"of {c}").alias(c) for c in EXTRA)).repartition(3)


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


#: Each gives a row for every row.
WHOLE = {
    "secrets": lambda d: secrets.scan(d, scratch_dir(d.sparkSession, "ledger")),
    "mixing": mixing.decide,
    "language": lambda d: language.predict(d, language.learn(d)),
    "near": near_dedup.classes,
    "quality": quality.judge,
    "lm": lambda d: lm.score(d, F.col("source") == "s"),
    "bpe": lambda d: bpe.round_trip(d, tokenizer()),
    "suffix": suffix_dedup.cut_repeats,
    "lines": lambda d: line_dedup.drop_units(d, levels=line_dedup.LEVELS),
    "exact": exact_dedup.dedup_decisions,
    "periodic": periodic.find_runs,
}
#: These give rows of the table, with its columns.
KEEP = {"near": near_dedup.drop_near, "quality": quality.filter_quality, "mixing": lambda d: mixing.take_rows(d, mixing.decide(d)), "exact": exact_dedup.drop_copies}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_has_a_result(spark, name):
    before = spark.conf.get(f"{ARROW}.maxRecordsPerBatch")
    found = WHOLE[name](awkward(spark))
    assert Counter(r.doc_id for r in found.select("doc_id").collect()) == Counter(r[0] for r in TABLE)
    assert spark.conf.get(f"{ARROW}.maxRecordsPerBatch") == before
    assert WHOLE[name](awkward(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", KEEP)
def test_columns_are_carried(spark, name):
    docs = awkward(spark)
    found = KEEP[name](docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[c] == f"of {c}" for r in rows for c in EXTRA) and {r.doc_id for r in rows} <= {r[0] for r in TABLE}
    assert KEEP[name](docs.limit(0)).count() == 0


def test_lines_keep_a_column_called_removed(spark):
    found = line_dedup.drop_units(awkward(spark), levels=line_dedup.LEVELS)
    assert {"removed", "removed_"} <= set(found.columns) and all(r.removed == "of removed" for r in found.select("removed").collect())


def test_alignment_of_very_long_texts_holds_its_band_only():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 60, 200_000)
    b = a.copy()
    b[r.choice(len(b), 4_000, replace=False)] = -1
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert near_dedup.alike(a, b)
    b[r.choice(len(b), 40_000, replace=False)] = -2
    assert not near_dedup.alike(a, b)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_recall_of_pairs_just_above_the_threshold():
    """Measured, not argued: of pairs at 0.80 to 0.85, how many share a sketch entry and pass the bits."""
    r, met, close = np.random.default_rng(7), 0, 0
    for k in range(600):
        n = int(r.integers(30, 400))
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        gone = int(n * (1 - (0.80 + 0.05 * (k % 6) / 5)))
        b = np.delete(a, r.choice(n, gone, replace=False))
        (ea, ba), (eb, bb) = near_dedup.sketch(a), near_dedup.sketch(b)
        met += bool(np.isin(ea, eb).any())
        close += int(np.bitwise_count((ba ^ bb).view(np.uint64)).sum()) <= near_dedup.MOST_BITS
    assert met >= 599 and close == 600


@pytest.mark.parametrize("anyway", [0, near_dedup.ANYWAY])
def test_pivots_find_what_all_pairs_find(spark, monkeypatch, anyway):
    """Three clusters of near copies around one boilerplate, with single texts between them: rounds of pivots, and all pairs at once."""
    monkeypatch.setattr(near_dedup, "MANY", 0 if not anyway else near_dedup.MANY)
    monkeypatch.setattr(near_dedup, "ANYWAY", anyway)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    shared = [word() for _ in range(70)]
    table = []
    for _ in range(3):
        own = [word() for _ in range(50)]
        for _ in range(24):
            t = shared + own
            for k in r.sample(range(len(t)), r.choice([0, 1, 2, 3])):
                t[k] = word()
            table.append((r.randrange(10**9), " ".join(t)))
    table += [(r.randrange(10**9), " ".join(shared + [word() for _ in range(50)])) for _ in range(6)]
    want = brute_classes(table)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()} == want and len(set(want.values())) >= 9
    # the rounds alone: all texts are members of one star of which no link is known yet
    members, hub = [], near_dedup.labelled(shingled(table[-1][1]))
    for i, t in table[:-1]:
        own = shingled(t)
        bits = near_dedup.sketch(own)[1].tolist()
        members.append((table[-1][0], i, len(own), *bits, len(np.setdiff1d(near_dedup.labelled(own), hub)), 9 * len(own)))
    common = spark.createDataFrame(members, "hub long, id long, n long, bits0 long, bits1 long, lacks int, most long")
    none = lambda schema: spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").alias("id"), packed("text").alias("t"))
    links = near_dedup._by_pivots(common, none("a long, b long"), none("id long, component long"), texts)
    found = {r.id: r.component for r in components(links).collect()}
    assert {i: found.get(i, i) for i, _ in table} == want


def test_a_large_component_has_one_cell_a_member(spark, monkeypatch):
    """Of a star's members only those outside its largest component are repeated for the cells beside their own."""
    repeated, inner = [], near_dedup._cells

    def seen(rows, around):
        if around:
            repeated.append(rows.count())
        return inner(rows, around)

    monkeypatch.setattr(near_dedup, "_cells", seen)
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, texts: pairs.selectExpr("a", "b", "true alike"))
    common = spark.createDataFrame([(0, i, 100 + i % 5, 0, 0, 10 + i % 3, 900) for i in range(1, 301)], "hub long, id long, n long, bits0 long, bits1 long, lacks int, most long")
    part = spark.createDataFrame([(i, 1) for i in range(1, 299)], "id long, component long")
    links = near_dedup._by_pivots(common, spark.createDataFrame([], "a long, b long"), part, None)
    assert {(r.a, r.b) for r in links.collect()} == {(i, j) for j in (299, 300) for i in range(1, j)} and repeated and max(repeated) == 2


def shingled(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return near_dedup.shingles(data, np.array([0, len(data)]))[0]


def test_short_texts_that_differ_by_one_shingle_are_candidates():
    r = np.random.default_rng(3)
    for n in range(2, near_dedup.FEW + 1):
        for k in range(n):
            a = r.integers(0, 1 << 62, n).astype(np.uint64)
            assert np.isin(near_dedup.sketch(a)[0], near_dedup.sketch(np.delete(a, k))[0]).any()


def brute_language(profiles, text, size=language.SIZE):
    def counted(t):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        c = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
        return Counter({g: v for g, v in c.items() if g != " " and not (len(g) == 3 and g[1] == " ")})

    # n-grams of fewer characters come first among equals, as numbers of 21 bits a character do
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), [ord(k) for k in x[0]]))][:size]
    own, ranks = order(counted(text)), {name: {g: i for i, g in enumerate(order(sum(map(counted, texts), Counter())))} for name, texts in profiles.items()}
    far = {name: sum(min(abs(r[g] - i), size) if g in r else size for i, g in enumerate(own)) for name, r in ranks.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


def test_languages_match_brute_force(spark):
    r = random.Random(2)
    say = {name: ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(60)] for name, letters in (("aa", "abcdeé"), ("bb", "bcdefg"), ("cc", "ghiß"))}
    table = [(str(i), " ".join(r.choice(say[name]) for _ in range(r.randint(3, 60))) + r.choice(["", "!", " 12 x'y"]), name) for i in range(60) for name in say]
    docs = spark.createDataFrame([(i, t, n if k % 2 else None) for k, (i, t, n) in enumerate(table)], "doc_id string, text string, lang string").repartition(2)
    learned = {name: [t for k, (_, t, n) in enumerate(table) if k % 2 and n == name] for name in say}
    found = language.predict(docs, language.learn(docs), keep=("doc_id", "text")).collect()
    for row in found:
        name, score = brute_language(learned, row.text)
        assert (row.lang_pred, round(row.score, 9)) == (name, round(score, 9))


def test_long_texts_are_counted_in_pieces():
    text = "ab, c'D  é1 " * 900
    whole = np.sort(language.ngrams(text))
    for step in (1, 2, 7, 1000):
        assert (np.sort(np.concatenate(list(language.pieces(text, step)))) == whole).all()
