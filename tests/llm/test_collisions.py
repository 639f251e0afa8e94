"""Words and lines whose polynomial hashes modulo 2**64 are equal though they differ, and texts with very many findings."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import line_dedup, lm, near_dedup, quality, secrets
from orograph.llm import words as W
from orograph.llm.shared import scratch_dir


def thue_morse(bits, a="a", b="b"):
    """A word of 2**bits letters and its complement: their hashes modulo 2**64 agree from 1024 letters on, whatever the radix."""
    w = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1 << bits))
    return w, w.translate(str.maketrans(a + b, b + a))


def arrays(*texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_the_plain_hash_collides_and_no_measure_does(bits):
    x, y = thue_morse(bits)
    data, offsets = arrays(x, y)
    plain = W.span_hash(W.running(W.BYTE[data]), offsets[:-1], offsets[1:])
    assert plain[0] == plain[1]
    ids = W.word_hashes(data, offsets[:-1], offsets[1:])
    assert ids[0] != ids[1]
    number = W.exact(data, np.array([0, offsets[1], 0]), np.array([offsets[1], offsets[2], offsets[1]]), np.array([plain[0]] * 3))
    assert number[0] == number[2] != number[1]
    lines, words = f"{x}\n{y}", " ".join([*"cdefghi", x, *"cdefghi", y])
    batch = quality.Batch(*arrays(lines, words, f"{x}\n{x}"))
    assert quality.n_dup_lines(batch).tolist() == [0, 0, 1]
    assert quality.n_repeat_words(batch).tolist() == [0, 0, 0]
    assert quality.n_repeat_words(quality.Batch(*arrays(" ".join([*"cdefghi", x, *"cdefghi", x])))).tolist() == [16]


def test_exact_numbers_equal_bytes():
    r = np.random.default_rng(2)
    for most in (1, 7, 1000):
        for _ in range(60):
            data = r.integers(97, 99, 60).astype(np.uint8)
            start = r.integers(0, 50, 40)
            end = start + r.integers(0, 9, 40)
            spans = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
            # a poor hash that many spans share
            number = W.exact(data, start, end, np.array([sum(s) % 5 for s in spans]), most)
            assert [[a == b for b in number] for a in number] == [[a == b for b in spans] for a in spans]
            assert number.max() < 2 * len(start)


def test_exact_windows():
    r = np.random.default_rng(3)
    for n in (0, 5, 8, 9, 100):
        x = r.integers(0, 2, n)
        at = np.arange(max(0, n - 7))
        got = W.exact_windows(x, at, 8)
        want = [tuple(x[i : i + 8]) for i in at]
        assert len(got) == len(want)
        assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_scores_tell_colliding_words_apart(spark):
    x, y = thue_morse(10)
    docs = spark.createDataFrame([(0, x), (1, x), (2, y)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 2).collect()}
    assert [rows[i].n_known for i in range(3)] == [2, 2, 1]


def test_near_copies_tell_colliding_words_apart(spark):
    x, y = thue_morse(10)
    words = "one two three four five six seven".split()
    docs = spark.createDataFrame([(0, " ".join([*words, x])), (1, " ".join([*words, y])), (2, " ".join([x, *words])), (3, x), (4, y)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}


def test_quality_query_measures(spark):
    x, y = thue_morse(11)
    docs = spark.createDataFrame([(0, f"{x}\n{y}\n"), (1, f"{x}\n{x}\n")], "doc_id long, text string")
    rows = {r.doc_id: r.n_dup_lines for r in quality.judge(docs, measures=("n_dup_lines",)).collect()}
    assert rows == {0: 0, 1: 1}


def test_findings_take_time_in_proportion(spark):
    times = []
    for k, n in enumerate((1000, 100_000)):
        one = "token=abcdef%06d "
        docs = spark.createDataFrame([(0, "".join(one % i for i in range(n)) + "Token=abcdefgh"), (1, "x" + one % 7 + "password:abc")], "doc_id long, text string")
        began = time.time()
        rows = {r.doc_id: r.findings for r in secrets.scan(docs, scratch_dir(spark, f"ledger{k}")).collect()}
        times.append(time.time() - began)
        width = len(one % 0)
        assert len(rows[0]) == n + 1 and len(rows[1]) == 1
        assert [(f.start, f.end) for f in rows[0]] == [*((i * width, (i + 1) * width - 1) for i in range(n)), (n * width, n * width + 14)]
    assert times[1] < 60


def test_lines_of_rows_without_ids(spark):
    line = "a line that is everywhere"
    rows = [(7, f"seven\n{line}\n"), (None, f"{line}\nnone\n"), (5, f"five\n{line}"), (None, f"other none\n{line}"), (None, f"{line}\nnone\n"), (5, f"five again\n{line}\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 99, r.text) for r in line_dedup.drop_units(docs, levels=line_dedup.LEVELS).collect()))
    assert got == [(5, f"five\n{line}"), (5, "five again\n"), (7, "seven\n"), (99, "none\n"), (99, "none\n"), (99, "other none\n")]
