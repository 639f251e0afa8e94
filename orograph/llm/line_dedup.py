r"""Removal of repeated lines (or paragraphs, or sentences within lines) by hashing.

A text is cut into units: ``line`` at line ends, ``paragraph`` at blank lines, ``sentence`` at line ends and behind a full stop,
question or exclamation mark that white space follows. A unit is normalised (A-Z lower-cased, white space runs one blank,
ends trimmed) and known by the first 16 bytes of its SHA-256. Over all documents, a unit's earliest occurrence by
(doc_id, place) stays and all others go, within a document too; rows without an id come after all others. Units of fewer than ``min_words`` words always stay.

Several levels can be cut at once, as in ``LEVELS``: paragraphs and lines go whole from one word on, whatever their sentences'
lengths, and sentences of ``MIN_WORDS`` or more also within lines that aren't repeated. All levels share the digests: a unit's place is
that of its first word, so one that holds the same words as the unit around it is that unit and isn't counted twice.

A task first reduces its own units to one row for each digest, so a unit that is in a third of all documents reaches the shuffle as
often as there are tasks. Digests met once are dropped there; the occurrences of the others get the earliest place by a join.

``removed`` tells the offsets (code points, end exclusive) of what went in the original text; of several levels, spans that overlap
are one. Defined results: a null text has no
units and stays null. Rows under one id, or none, are told apart by their texts (a 64-bit hash, within the id only) and ranked by place; equal rows lose the same. Extra columns
are carried by ``drop_units`` whatever their names (where one is called ``removed``, the spans are in ``removed_``). An empty table gives no rows; a very long text is cut whole.
"""

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .shared import each, materialise, own_names, with_verdicts

#: White space is that of ASCII.
WS = r"[ \t\n\r\x0b\x0c]"
CUTS = {"line": regex.compile(r"\n"), "paragraph": regex.compile(rf"\n[ \t]*\n{WS}*"), "sentence": regex.compile(rf"\n|(?<=[.!?]){WS}+")}
MIN_WORDS = 5
#: What the registered query cuts by, coarse units first, each with its least number of words.
LEVELS = (("paragraph", 1), ("line", 1), ("sentence", MIN_WORDS))
BLANK = " \t\n\r\x0b\x0c"


def units(text: str, unit: str = "sentence") -> list[tuple[int, int]]:
    """Start and end of each unit; what the cuts match belongs to the unit before."""
    at, out = 0, []
    for m in CUTS[unit].finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def digest(text: str, min_words: int) -> bytes | None:
    words = text.encode().lower().split()
    return hashlib.sha256(b" ".join(words)).digest()[:16] if len(words) >= min_words else None


def text_units(text: str, levels) -> list[tuple[bytes, int, int, int]]:
    """digest, start, end and blanks before the first word of the units of all levels."""
    out, seen, spans = [], set(), set()
    for unit, min_words in levels:
        for span in units(text, unit):
            if span in spans:
                continue
            a, b = span
            part = text[a:b]
            if (d := digest(part, min_words)) is not None:
                lead = len(part) - len(part.lstrip(BLANK))
                if (d, a + lead) not in seen:
                    seen.add((d, a + lead))
                    spans.add(span)
                    out.append((d, a, b, lead))
    return out


def occurrences(docs: DataFrame, levels, doc_id: str, text: str) -> DataFrame:
    """``doc_id, mark, digest, start, stop, lead`` for each unit of a document; the mark tells rows under one id apart by their texts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                take, found = [], []
                for i, t in enumerate(rows.column(2).to_pylist()):
                    mine = text_units(t or "", levels)
                    take += [i] * len(mine)
                    found += mine
                digests, starts, ends, leads = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(take, pa.int64())) for c in (0, 1)), pa.array(digests, pa.binary()), *(pa.array(x, pa.int32()) for x in (starts, ends, leads))], ["doc_id", "mark", "digest", "start", "stop", "lead"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, mark long, digest binary, start int, stop int, lead int")


@F.arrow_udf(ArrayType(StructType().add("start", IntegerType()).add("stop", IntegerType())))
def without_overlaps(spans: pa.Array) -> pa.Array:
    """Overlapping spans of a row made one; rows are sorted, and spans that only touch stay apart."""
    flat = spans.flatten()
    start, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    edges = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    row = np.repeat(np.arange(len(spans)), np.diff(edges))
    far = np.maximum.accumulate(stop + (row << 32)) if len(row) else stop
    new = np.append(True, start[1:] + (row[1:] << 32) >= far[:-1])[: len(row)]
    at = np.flatnonzero(new)
    stop = (far - (row << 32))[np.append(at[1:] - 1, len(row) - 1)] if len(at) else stop
    merged = pa.StructArray.from_arrays([pa.array(start[at], pa.int32()), pa.array(stop, pa.int32())], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, edges), pa.int32()), merged)


def removals(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", levels=None) -> DataFrame:
    """``doc_id, mark, removed`` (array of start, stop in the order of the text) of the documents that lose something; ``levels`` stand in for unit and min_words."""
    found = materialise(occurrences(docs, levels or ((unit, min_words),), doc_id, text), "units")
    place = F.col("start") + F.col("lead")
    # rows without an id come last
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place.alias("place"), "mark")
    first = materialise(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    again = with_verdicts(found, first, "digest", "n").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (place == F.col("first.place")) & (F.col("mark") == F.col("first.mark"))))
    # at most a document's own units meet here
    gone = again.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    return gone.withColumn("removed", without_overlaps("removed")) if levels else gone


@F.arrow_udf(StringType())
def without_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without its spans, which are sorted and don't overlap."""
    out = []
    for t, gone in zip(each(text), each(spans), strict=True):
        if t is not None and gone:
            ends, begins = [0, *(x["stop"] for x in gone)], [*(x["start"] for x in gone), len(t)]
            t = "".join(t[a:b] for a, b in zip(ends, begins, strict=True))
        out.append(t)
    return pa.array(out, pa.string())


def drop_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", levels=None) -> DataFrame:
    """docs with what remains of each text in ``text``, and the removed spans in ``removed``."""
    name, mark, removed = own_names(docs.columns, "id_of", "mark_of", "removed")
    spans = removals(docs, unit, min_words, doc_id, text, levels).select(F.col("doc_id").alias(name), F.col("mark").alias(mark), F.col("removed").alias(removed))
    rows = docs.join(spans, docs[doc_id].eqNullSafe(spans[name]) & (F.xxhash64(docs[text]) == spans[mark]), "left").drop(name, mark)
    kept = F.when(F.col(removed).isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col(removed)))
    return rows.withColumn(text, kept).withColumn(removed, F.coalesce(removed, F.array().cast("array<struct<start:int,stop:int>>")))
