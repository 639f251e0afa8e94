r"""Mixing sources to target weights by capped water-filling.

The size of a document is its number of words. The mix has ``ratio`` times all words. Sources share it by weight; a source's
target stops at ``max_epochs`` times its size and what it can't take is shared among the others by weight, until no
target is above its cap. A target of e epochs takes every document floor(e) times whole, then walks the source in a seeded
order and takes documents once more until the target is met; the document at the end of the walk is taken in part.

The seeded order is that of md5(seed:doc_id). The walk is done over ``2**bits`` ranges of that order first, then over as many ranges of the one where
the target falls, and only the last range is walked by rows: no source, however large, is sorted in one task.

Defined results: a null text has no words; a null source is a source of its own, last in the order of sources. Rows with
equal md5 keys (repeated ids) are walked in the order of size, and equal rows take the same amount each (the walk's, by rank among
them, may differ between such rows only). With no words at all every target is 0. An empty table gives no rows. Weights of 0 or
null take nothing. Extra columns are carried by ``take_rows``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.shared import numbered

from .shared import materialise, own_names

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def cycling_weights(sources: DataFrame, weights=(5.0, 2.0, 1.0)) -> DataFrame:
    """Gives the sources, in the order of their code points and null last, the weights in turn."""
    turn = F.pmod(F.col("turn"), F.lit(len(weights))).cast("int")
    return numbered(sources, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).drop("turn")


def water_fill(sources: DataFrame, ratio: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with their ``target`` (double). A round clamps every source whose share is
    above its cap; the driver sees the totals only. Ends after as many rounds as there are sources at most."""
    cap = F.col("source_size") * max_epochs
    state = materialise(sources.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).withColumn("full", F.lit(False)), "water")
    total = ratio * (state.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        weight, taken = state.agg(F.sum(F.when(~F.col("full"), F.col("weight"))), F.sum(F.when(F.col("full"), cap))).first()
        level = (total - (taken or 0.0)) / weight if weight else 0.0
        share = F.col("weight") * F.lit(float(level))
        above = ~F.col("full") & (share > cap)
        if state.where(above).isEmpty():
            return state.select("source", "source_size", "weight", F.when(F.col("full"), cap).otherwise(share).cast("double").alias("target"))
        state = materialise(state.withColumn("full", F.col("full") | above), "water")


def order_key(doc_id, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def decide(docs: DataFrame, weigh=cycling_weights, ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 17, bits: int = 12,
           doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of docs; weigh gives sources (source, source_size)
    a column weight."""
    key = order_key(F.col(doc_id), seed)
    digits = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("key"), digits.alias("digits"))
    rows = rows.withColumns({f"cell{k}": F.shiftright("digits", 32 - (k + 1) * bits).bitwiseAND((1 << bits) - 1).cast("int") for k in range(2)}).drop("digits")
    rows = materialise(rows, "sizes")
    cells = materialise(rows.groupBy("source", "cell0").agg(F.sum("size").alias("cell_size")), "cells")
    sources = water_fill(weigh(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))), ratio, max_epochs)
    # the words of the last, broken epoch
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = materialise(sources.withColumn("left", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long")), "sources")
    of = [c for c in sources.columns if c != "source"]
    # all cells of a source before the broken one go in whole, all behind it stay out; the broken one is walked in cells of its own, and
    # of these the broken one row by row: a 2**(2 * bits)-th of the source
    first = walked(rows, cells, sources, "cell0", of)
    second = first.where("kind = 2").drop("kind", "more")
    inner = second.groupBy("source", "cell1").agg(F.sum("size").alias("cell_size"))
    broken = materialise(second.groupBy("source").agg(*(F.first(c).alias(c) for c in of)), "broken")
    second = walked(second.drop(*of), inner, broken, "cell1", of)
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = second.where("kind = 2").withColumn("gone", F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("more", F.greatest(F.lit(0), F.least(F.col("left") - F.col("gone"), F.col("size"))).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")]
    return first.where("kind < 2").select(columns).union(second.where("kind < 2").select(columns)).union(last.select(columns))


def walked(rows: DataFrame, cells: DataFrame, sources: DataFrame, cell: str, of: list[str]) -> DataFrame:
    """rows with the columns ``of`` of their source, where ``left`` becomes what is left for the row's cell in the walk of the source's
    cells (source, cell, cell_size), ``kind`` (0: nothing is left, 1: enough for all of it, 2: the broken one) and ``more``, the words taken where kind is 0 or 1."""
    # at most 2**bits cells for a source, so this window is bounded
    walk = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    edges = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(walk), F.lit(0)))
    edges = edges.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    left = F.greatest(F.lit(0), F.least(F.col("left") - F.col("before"), F.col("cell_size"))).cast("long")
    kind = F.when(left == 0, 0).when(left == F.col("cell_size"), 1).otherwise(2)
    edges = edges.select(F.col("source").alias("s"), F.col(cell).alias("c"), kind.alias("kind"), *(left.alias(c) if c == "left" else F.col(c) for c in of))
    known = rows.join(edges, rows["source"].eqNullSafe(edges["s"]) & (rows[cell] == edges["c"])).drop("s", "c")
    return known.withColumn("more", F.when(F.col("kind") == 1, F.col("size")).otherwise(F.lit(0)).cast("long"))


def take_rows(docs: DataFrame, decided: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. A document taken in part is taken
    once more if that part is half of it or more, so every row keeps its whole text. Rows that share an id are each taken as often as one of them."""
    name, copy, times = own_names(docs.columns, "id_of", "copy_of", "times_of")
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    found = decided.select(F.col("doc_id").alias(name), n.alias(times)).groupBy(name).agg(F.max(times).alias(times)).where(F.col(times) > 0)
    rows = docs.join(found, docs[doc_id].eqNullSafe(found[name]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in docs.columns))
