import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import bpe, graph, language, line_dedup, near_dedup

from .fixture import frame, rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


def shingle_list(text):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def ordered_similarity(a, b):
    if not a or not b:
        return 0.0
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1] / (len(a) + len(b) - last[-1])


def brute_classes(table):
    texts = {r[0]: shingle_list(r[1]) for r in table}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = texts[i], texts[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and set(a) & set(b) and ordered_similarity(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_classes_match_brute_force(docs):
    got = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
    want = brute_classes(rows())
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_empty_and_repeated(spark, docs):
    assert near_dedup.classes(docs.limit(0)).count() == 0
    twice = near_dedup.classes(docs.where("n < 20").union(docs.where("n < 20")))
    once = {r.doc_id: r.class_id for r in near_dedup.classes(docs.where("n < 20")).collect()}
    assert Counter((r.doc_id, r.class_id) for r in twice.collect()) == Counter({x: 2 for x in once.items()})


def test_near_chain_and_large_group(spark):
    r = random.Random(3)
    w = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    table = []
    for i in range(60):  # a chain: far ends are under the threshold, neighbours over it
        v = list(w)
        v[: i * 4] = [f"x{k}" for k in range(i * 4)]
        table.append((i, " ".join(v)))
    other = [f"v{r.randint(0, 10**6)}" for _ in range(200)]
    for i in range(100, 400):
        v = list(other)
        v[r.randrange(200)] = f"y{i}"
        table.append((i, " ".join(v)))
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert all(got[i] == 100 for i in range(100, 400)) and all(got[i] == 0 for i in range(60))


def test_alignment_is_exact():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(12 if _ % 2 else 10**6) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.1]
        if r.random() < 0.5 and b:
            b[r.randrange(len(b))] = -1
        for least in (0.5, 0.8):
            want = bool(b) and ordered_similarity(a, b) >= least - 1e-12
            assert near_dedup.alike(np.array(a, np.int64), np.array(b, np.int64), least) == want


def test_sketch_finds_similar_pairs():
    r = np.random.default_rng(2)
    for _ in range(100):
        a = r.integers(0, 1 << 62, 90).astype(np.uint64)
        b = np.delete(a, r.choice(90, 18, replace=False))
        assert (near_dedup.sketch(a)[0] == near_dedup.sketch(b)[0]).any()
    c = r.permutation(a)
    assert (near_dedup.sketch(a)[0] == near_dedup.sketch(c)[0]).sum() < 10  # order counts


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_lines_match_brute_force(docs, unit):
    first, gone = {}, defaultdict(list)
    for doc_id, text, *_ in sorted(rows(), key=lambda x: x[0]):
        for a, b in line_dedup.units(text or "", unit):
            w = text[a:b].encode().lower().split()
            if len(w) >= 5 and first.setdefault(b" ".join(w), (doc_id, a)) != (doc_id, a):
                gone[doc_id].append((a, b))
    left = line_dedup.drop_units(docs, unit)
    assert left.columns == [*docs.columns, "removed"]
    got = {r.doc_id: r for r in left.collect()}
    for doc_id, text, *_ in rows():
        assert [(x.start, x.stop) for x in got[doc_id].removed] == gone[doc_id]
        if text is not None:
            keep = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in gone[doc_id]))
            assert got[doc_id].text == keep
    assert any(gone.values()) and line_dedup.drop_units(docs.limit(0), unit).count() == 0


def test_repeated_lines_of_short_sentences_go_whole(spark, tmp_path):
    """The registered query: a line or paragraph that is repeated goes whole, and long sentences also go from lines that stay."""
    from orograph.llm import queries

    long_ = "this sentence has more than five words."
    texts = ["Yes. No.\n" + long_ + " So.\nend", "first\n yes.  NO.\n" + long_ + " Other.\n", "  \nend\n\nA b.\nC d.\n\nlast", "a b. c d.\nonce  only\n\n\n", " alone", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    left = {0: texts[0], 1: "first\nOther.\n", 2: "A b.\nC d.\n\nlast", 4: texts[4], 5: "", 6: ""}
    assert {i: r.kept_sha256 for i, r in got.items() if i in left} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert got[1].n_removed == 2 and got[2].removed == "0:8" and got[3].removed == "0:10"


def test_levels_match_brute_force(spark):
    """Of each content the earliest unit of any level stays; what goes is the union of all later ones."""
    r = random.Random(6)
    said = ["yes.", "No!", "a b c d e f.", "one two three four five six?", "x", "q r s t u v w"]
    table = [(i * 5 % 61, "".join(r.choice(said) + r.choice([" ", "  ", "\n", "\n", "\n\n", "\n \n  ", "\n\n\n"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    first, at = {}, {}
    for i, t in sorted(table):
        at[i] = []
        for unit, least in line_dedup.LEVELS:
            for a, b in line_dedup.units(t, unit):
                w = t[a:b].lower().split()
                if len(w) >= least:
                    place = a + len(t[a:b]) - len(t[a:b].lstrip())
                    at[i].append((" ".join(w), place, a, b))
                    first[" ".join(w)] = min(first.get(" ".join(w), (i, place)), (i, place))
    got = {x.doc_id: x for x in line_dedup.drop_units(spark.createDataFrame(table, "doc_id long, text string").repartition(3), levels=line_dedup.LEVELS).collect()}
    for i, t in table:
        gone = {k for w, place, a, b in at[i] if first[w] != (i, place) for k in range(a, b)}
        mine = got[i].removed
        words = {k for k in range(len(t)) if not t[k].isspace()}
        assert {k for x in mine for k in range(x.start, x.stop)} & words == gone & words
        assert all(x.stop <= y.start for x, y in zip(mine, mine[1:], strict=False))
        assert got[i].text == "".join(c for k, c in enumerate(t) if not any(x.start <= k < x.stop for x in mine))
    assert any(x.removed for x in got.values())


def test_units_cover_the_text():
    for _, text, *_ in rows():
        for unit in line_dedup.CUTS:
            spans = line_dedup.units(text or "", unit)
            assert "".join((text or "")[a:b] for a, b in spans) == (text or "")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    p = language.learn(docs.where("not held_out"))
    assert p.names == ["de", "en", "es", "fr"] and p.ranks.shape[0] == 4
    r = language.predict(docs.where("held_out"), p, keep=("lang",)).collect()
    assert np.mean([x.lang == x.lang_pred for x in r]) > 0.9 and all(0 <= x.score <= 1 for x in r)


def test_language_edges(spark, docs):
    p = language.learn(docs)
    assert p.names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(docs, p).collect()}
    for doc_id, text, *_ in rows():
        assert (got[doc_id].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    none = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_language_distance_by_hand():
    own = {"aa": language.profile("banana banana"), "bb": language.profile("kiwi kiwi")}
    assert language.Profiles(own).nearest("banana banana") == ("aa", 1.0)
    want = Counter(g for w in ("ab", "a") for g in [*w, *(f" {w} "[i : i + 2] for i in range(len(w) + 1)), *(f" {w} "[i : i + 3] for i in range(len(w)))])
    keys, counts = np.unique(language.ngrams("Ab, a!"), return_counts=True)
    assert sorted(counts) == sorted(want.values())


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


POOL = ["a", "e", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "é", "नम", "😀", "!", "$$", "<|endoftext|>", "<|endo", "　", "\x1c", "\x85", "Ⅷ", "aaaa", "th", "-----"]


def test_bpe_equals_the_library(tokenizer):
    path, t = tokenizer
    e, r = bpe.encoder(path), random.Random(4)
    for k in range(600):
        s = "".join(r.choice(POOL) for _ in range(r.randint(0, 60))) if k % 20 else "".join(r.choice(r.choice(["ab", "-=", "ation", "12", " \n"])) for _ in range(3)) * r.randint(1, 4000)
        want = t.encode(s, add_special_tokens=False).ids
        assert e.encode(s) == want
        stream, got, at, most = e.stream(), [], 0, 0
        while at < len(s):
            to = at + r.randint(1, 9 if k % 20 else 900)
            got += stream.feed(s[at:to])
            most, at = max(most, len(stream.text)), to
        assert got + stream.close() == want and most < 3000
        d = bpe.Decoder(e.model)
        assert "".join(d.feed(want[i : i + 3]) for i in range(0, len(want), 3)) + d.close() == t.decode(want, skip_special_tokens=False)


def test_bpe_lookahead_by_brute_force():
    """Over all strings of a small alphabet: a token that ends the lookahead before a prefix's end is the same in every extension."""
    from itertools import product

    merges = ["a b", "b c", "c a", "ab c", "b ca", "a bca", "bc b", "c ab"]
    vocab = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    for m in merges:
        vocab[m.replace(" ", "")] = len(vocab)
    model = bpe.Model(vocab, merges, {})

    def stable(ids, safe):
        out, at = [], 0
        for i in ids:
            at += len(model.bytes[i])
            if at > safe:
                return out
            out.append(i)
        return out

    for n in range(1, 10):
        for s in product(b"abc", repeat=n):
            whole = model.merged(bytes(s))
            for k in range(1, n):
                part = stable(model.merged(bytes(s[:k])), k - model.lookahead)
                assert whole[: len(part)] == part


def test_bpe_window_holds(tokenizer):
    path, _ = tokenizer
    model = bpe.encoder(path).model
    assert 0 < model.lookahead < 400
    t, r = bpe.Transducer(model), random.Random(2)
    data = bytes(r.choice(b"aeinorst") for _ in range(60_000))
    got = []
    for i in range(0, len(data), 777):
        got += t.feed(data[i : i + 777])
        assert len(t.held) < model.window + 777
    assert got + t.close() == model.merged(data)


def test_bpe_round_trip(spark, docs, tokenizer):
    path, t = tokenizer
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, step=100).collect()}
    for doc_id, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows())
    assert bpe.round_trip(docs.limit(0), path).count() == 0
