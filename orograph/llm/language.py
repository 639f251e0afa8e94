"""Language identification by rank-order profiles of character n-grams.

A profile is the ``size`` most frequent n-grams of 1 to 3 characters, in order. n-grams are of lower-cased letters, with one blank
for whatever stands between words, and never go over a blank. A text's language is the one whose profile is nearest to the
text's own by the out-of-place distance: the sum over the text's n-grams of how far apart the two ranks are, ``size`` for an
n-gram that the language lacks. The score is 1 minus the distance's share of the largest possible one.

Profiles are learned from a bounded sample: about ``sample_rows`` labelled rows of each language, chosen by a hash of the id. More than
``MAX_LANGUAGES`` labels are an error, as profiles go to every task.

Defined results: a null text and one without letters are ``und`` with score 0, and so is every text if nothing was learned. Ties
between n-grams go to the smaller code points, between languages to the first by code points. Rows without a label
are predicted but not learned from. Repeated rows get the same answer. An empty table gives no rows.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import each, materialise, own_names, small_batches

SIZE, SAMPLE_ROWS, MAX_LANGUAGES = 300, 4000, 2000
BITS = 21


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str, step: int = 1 << 16):
    """All n-grams as numbers, those that end in some thousand characters at a time: 21 bits for a character, the last one lowest."""
    text, held = text.lower(), np.array([32], np.int64)
    for at in range(0, len(text) + 1, step):
        codes = np.frombuffer(text[at : at + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, 32).astype(np.int64)
        if at + step > len(text):
            codes = np.append(codes, 32)
        codes = codes[(codes != 32) | (np.append(held[-1], codes[:-1]) != 32)] if len(codes) else codes
        h, codes = len(held), np.concatenate([held, codes])
        two = (codes[:-1] << BITS) | codes[1:]
        three = (two[:-1] << BITS) | codes[2:]
        yield np.concatenate([codes[h:][codes[h:] != 32], two[h - 1 :], three[max(h, 2) - 2 :][codes[max(h, 2) - 1 : -1] != 32]])
        held = codes[-2:]


def ngrams(text: str) -> np.ndarray:
    return np.concatenate(list(pieces(text)))


def top(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent keys in order; keys come in ascending order."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def profile(text: str, size: int = SIZE) -> np.ndarray:
    """The text's own profile. Of a long text only the counts of distinct n-grams are held."""
    keys = counts = np.zeros(0, np.int64)
    for part in pieces(text):
        more, n = np.unique(part, return_counts=True)
        keys, counts = (more, n) if not len(keys) else merged(np.append(keys, more), np.append(counts, n))
    return top(keys, counts, size)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


class Profiles:
    """Profiles of some languages: languages times ``size`` numbers."""

    def __init__(self, by: dict[str, np.ndarray], size: int = SIZE):
        self.names, self.size = sorted(by), size
        self.keys = np.unique(np.concatenate([*by.values(), np.zeros(0, np.int64)]).astype(np.int64))
        self.ranks = np.full((len(self.names), len(self.keys)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.keys, by[name])] = np.arange(len(by[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return "und", 0.0
        own = profile(text, self.size)
        if len(own) <= 1:  # the two blanks around nothing
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == own, self.ranks[:, at], -1)
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.size * len(own)))


def learn(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", size: int = SIZE, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles from the rows of docs that have a label. The driver gets ``size`` n-grams of each language."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    rows = labelled.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = {r["label"]: min(1.0, sample_rows / r["count"]) for r in rows}
    if not shares:
        return Profiles({}, size)
    share = F.create_map(*(F.lit(v) for kv in shares.items() for v in kv))[F.col("label")]
    sample = labelled.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("label", "text")

    def count(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            by: dict[str, list] = {}
            for name, value in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                for part in pieces(value):
                    by.setdefault(name, []).append(np.unique(part, return_counts=True))
            for name, found in by.items():
                keys, counts = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], ["label", "key", "n"])

    sums = sample.mapInArrow(count, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= size)
    by: dict[str, list] = {}
    with small_batches(docs.sparkSession):
        rows = best.orderBy("label", "rank").collect()
    for r in rows:
        by.setdefault(r["label"], []).append(r["key"])
    return Profiles({k: np.array(v, np.int64) for k, v in by.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, ``lang_pred`` and ``score``."""
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"
    n = len(kept.columns)

    def run(batches):
        for batch in batches:
            found = [profiles.nearest(t) for t in each(batch.column(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).alias(own_names(kept.columns, "text_of")[0]))
    return materialise(rows.mapInArrow(run, schema), "languages")
