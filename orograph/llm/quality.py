r"""Quality rules as a short-circuit cascade.

Each rule has a measure (computed for whole Arrow batches) and a limit. A bounded sample tells what a rule costs a row
and which share of rows it rejects; rules then run in the order of rejection per cost, each only over the rows that all
rules before it have let pass, so a document's measures are computed until the first rejection. The order decides cost alone:
a document is kept if no rule rejects it, whatever the order.

Defined results: a null text has no words and, as any text under ``MIN_WORDS`` words, fails. Repeated rows get the same
verdict each. An empty table gives no rows and the rules stay in the given order. Extra columns are carried by
``filter_quality``. A very long text is measured whole. Lines and windows of words are equal if their bytes are.
"""

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import words as W
from .shared import materialise, small_batches

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOL, UPPER, LOWER_, BANG = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"!"))


class Batch:
    """Texts of some rows; measures are computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n, self.known = data, offsets, len(offsets) - 1, {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]

    def take(self, rows: np.ndarray) -> "Batch":
        sizes = (self.offsets[1:] - self.offsets[:-1])[rows]
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows]
        out = Batch(np.concatenate(parts) if parts else self.data[:0], np.concatenate([[0], np.cumsum(sizes)]))
        out.known = {k: v[rows] for k, v in self.known.items() if isinstance(v, np.ndarray) and len(v) == self.n and k in MEASURES}
        return out

    def count(self, table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[self.data])])
        return (sums[self.offsets[1:]] - sums[self.offsets[:-1]]).astype(np.int64)

    def shared(self, name: str, make: Callable):
        if (key := f"_{name}") not in self.known:
            self.known[key] = make()
        return self.known[key]

    def words(self):
        return self.shared("words", lambda: W.words(self.data, self.offsets))

    def sums(self):
        return self.shared("sums", lambda: W.running(W.BYTE[self.data]))

    def lines(self):
        def make():
            breaks = np.flatnonzero(self.data == 10)
            row = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, breaks, "right") - 1])
            start = np.concatenate([self.offsets[:-1], breaks + 1])
            order = np.argsort(row, kind="stable")
            row, start = row[order], start[order]
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            end = np.where(last, self.offsets[1:][row], np.append(start[1:], 0)[: len(row)] - 1)
            full = np.concatenate([[0], np.cumsum(~W.SPACE[self.data])])
            keep = full[end] > full[start]
            return start[keep], end[keep], row[keep]

        return self.shared("lines", make)


def n_words(b: Batch) -> np.ndarray:
    return W.per_row(b.words()[2], b.n)


def word_chars(b: Batch) -> np.ndarray:
    return b.count(~W.SPACE & ((np.arange(256) & 0xC0) != 0x80))


def n_dup_lines(b: Batch) -> np.ndarray:
    start, end, row = b.lines()
    number = W.exact(b.data, start, end, W.span_hash(b.sums(), start, end))
    first = np.unique(row * (2 * len(row)) + number, return_index=True)[1]
    return W.per_row(row, b.n) - W.per_row(row[first], b.n)


def n_repeat_words(b: Batch) -> np.ndarray:
    start, end, row = b.words()
    at = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :]) if len(row) >= WINDOW else row[:0]
    if not len(at):
        return np.zeros(b.n, np.int64)
    number = W.exact_windows(W.exact(b.data, start, end, W.word_hashes(b.data, start, end)), at, WINDOW)
    _, which, times = np.unique(row[at] * (int(number.max()) + 1) + number, return_inverse=True, return_counts=True)
    found = at[times[which] > 1]
    cover = np.zeros(len(row) + 1, np.int32)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return W.per_row(row[np.cumsum(cover[:-1]) > 0], b.n)


MEASURES: dict[str, Callable[[Batch], np.ndarray]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": lambda b: b.count(SYMBOL),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": lambda b: W.per_row(b.lines()[2], b.n),
    "n_upper": lambda b: b.count(UPPER),
    "n_lower": lambda b: b.count(LOWER_),
    "n_bangs": lambda b: b.count(BANG),
}


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which ``rejects(batch)`` is true."""

    name: str
    rejects: Callable[[Batch], np.ndarray]


BASE_RULES = (
    Rule("few_words", lambda b: b.get("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda b: 100 * b.get("n_repeat_words") > REPEAT_PERCENT * b.get("n_words")),
)
MORE_RULES = (
    Rule("symbols", lambda b: 10 * b.get("n_symbols") > 3 * b.get("n_words")),
    Rule("bangs", lambda b: 2 * b.get("n_bangs") > b.get("n_words")),
    Rule("capitals", lambda b: (b.get("n_upper") > 20) & (2 * b.get("n_upper") > 3 * b.get("n_lower"))),
    Rule("repeated_lines", lambda b: 5 * b.get("n_dup_lines") > 2 * b.get("n_lines")),
    Rule("word_length", lambda b: (b.get("word_chars") > 20 * b.get("n_words")) | (b.get("word_chars") < 2 * b.get("n_words"))),
)
RULES = BASE_RULES + MORE_RULES


def cascade(batch: Batch, rules: Iterable[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows pass, and the number (from 0) of the rule that rejects a row, -1 for none."""
    alive, by = np.arange(batch.n), np.full(batch.n, -1)
    for i, rule in enumerate(rules):
        bad = np.asarray(rule.rejects(batch), bool)
        if bad.any():
            by[alive[bad]] = i
            alive, batch = alive[~bad], batch.take(np.flatnonzero(~bad))
        if not len(alive):
            break
    return by < 0, by


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 400) -> list[Rule]:
    """The rules by rejections per second over a sample of ``sample_rows`` rows at most, each rule measured alone."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in W.chunks(batches, "t"):
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                n = int(np.sum(rule.rejects(Batch(data, offsets))))
                yield pa.RecordBatch.from_pydict({"rule": [i], "n": [len(offsets) - 1], "rejected": [n], "s": [time.perf_counter() - began]})

    sample = docs.select(F.col(text).alias("t")).limit(sample_rows)
    sums = sample.mapInArrow(measure, "rule long, n long, rejected long, s double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("r"), F.sum("s").alias("s"))
    with small_batches(docs.sparkSession):
        rows = sums.collect()
    # half a rejection more, so that of rules without one the cheaper goes first
    score = {r["rule"]: (r["r"] + 0.5) / max(r["s"], 1e-9) for r in rows}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-score.get(i, 0.0), i))]


def judge(docs: DataFrame, rules=None, measures=("n_words",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the given measures of every row, ``kept`` and ``rejected_by`` (the first rule of the cascade that rejects)."""
    rules = order_rules(docs, text=text) if rules is None else list(rules)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + "".join(f"{m} long, " for m in measures) + "kept boolean, rejected_by string"
    names = np.array([r.name for r in rules] + [None], object)

    def run(batches):
        for rows, data, offsets in W.chunks(batches, "text"):
            batch = Batch(data, offsets)
            cols = [pa.array(batch.get(m), pa.int64()) for m in measures]
            kept, by = cascade(batch, rules)
            yield pa.RecordBatch.from_arrays([rows.column(0), *cols, pa.array(kept), pa.array(names[by], pa.string())], ["doc_id", *measures, "kept", "rejected_by"])

    return materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema), "judged")


def filter_quality(docs: DataFrame, rules=None, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns. Python is sent the text and answers with a boolean; rows stay with Spark."""
    rules = order_rules(docs, text=text) if rules is None else list(rules)

    @F.arrow_udf(BooleanType())
    def passes(values: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([values], ["text"])
        return pa.array(np.concatenate([np.zeros(0, bool), *(cascade(Batch(data, offsets), rules)[0] for _, data, offsets in W.chunks([batch]))]))

    return docs.where(passes(F.col(text)))
