"""Connected components of an edge table, as joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest id it is connected with) of every id in edges.

    Alternates two steps that only move edges: every larger neighbour of an id is tied to the id's smallest neighbour, then
    every smaller one is. Equal ties are one before they are joined again, and their shuffle lets both uses share one join. A hub's neighbours are reduced to a minimum before rows move, so no neighbourhood is collected.
    Ends when the edges no longer change, after about as many rounds as the logarithm of the longest path."""
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()
    now = materialise(now, "edges")
    # no round has more than twice the edges of the last
    count, seen = now.count(), None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x and y != m").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        # now u < v: tie an id's smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        now = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u != v").distinct()
        now = materialise(now, "edges", 2 * count)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        count, seen = state[0], state
    return now.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component")).union(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())


def extended(part: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` with further edges: known components are single ids in the search, so it is as large as what is new."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    fresh = both.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(part, "id", "left_anti")
    every = part.select("id", "component").unionByName(fresh.select("id", F.col("id").alias("component")))
    of = lambda c: every.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = both.join(of("a"), "a").join(of("b"), "b").select("of_a", "of_b").where("of_a != of_b")
    found = components(between, "of_a", "of_b").select(F.col("id").alias("component"), F.col("component").alias("least"))
    return every.join(found, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
