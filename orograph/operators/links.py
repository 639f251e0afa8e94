"""Successor pointers: rows that each name the next one, followed from a start in as many rounds as the logarithm of the way.

What is walked one step at a time elsewhere (a ring's edges, the shelves of an atlas, the events that a throttle lets through) becomes: a pointer for
every row at once, found by joins or scans, then ``reached``. No group is held in one task, however long its way is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.shared import Ranges, settled


def _beside(a: DataFrame, b: DataFrame, by, name: str) -> DataFrame:
    """a joined with b's other columns where the groups (nulls are one, too) and the named column are equal."""
    of = {c: f"__of_{c}" for c in (*by, name)}
    b = b.withColumnsRenamed(of)
    same = a[name] == b[of[name]]
    for c in by:
        same = same & a[c].eqNullSafe(b[of[c]])
    return a.join(b, same).drop(*of.values())


def reached(links: DataFrame, starts: DataFrame, by=()) -> DataFrame:
    """``by, node, step``: the nodes that are met on the way from each start, and after how many steps first (0 for the start).

    links: by, node, next (one row a node; null, or a node without a row, ends the way). starts: by, node. A way may close at its start or run into a
    ring: each node counts once. A round doubles the reach of all pointers and the stretch of the way that is known."""
    by = list(by)
    jump = links.where(F.col("next").isNotNull()).select(*by, "node", "next").transform(settled)
    known = starts.select(*by, "node", F.lit(0).cast("long").alias("step")).transform(settled)
    size, have = 1, known.count()
    while have:
        # what a jump of this size leads to from all that is known
        ahead = _beside(known, jump, by, "node").select(*by, F.col("next").alias("node"), (F.col("step") + size).alias("step"))
        known = known.unionByName(ahead).groupBy(*by, "node").agg(F.min("step").alias("step")).transform(settled)
        now = known.count()
        if now == have:
            break
        further = jump.select(*by, F.col("node").alias("next"), F.col("next").alias("__far"))
        jump = _beside(jump, further, by, "next").select(*by, "node", F.col("__far").alias("next")).transform(settled)
        size, have = size * 2, now
    return known


def first_at_least(rows: DataFrame, probes: DataFrame, by=()) -> DataFrame:
    """probes (by, probe, bound) with ``node``: of rows (by, node, value) the one of the least value that is ``bound`` or more, of equal ones the least node; null
    if there is none. Both are put in one order and scanned from its end, so it is no join by inequality."""
    by = list(by)
    both = rows.select(*by, F.col("value").alias("__at"), F.lit(0).alias("__kind"), "node", F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    both = both.unionByName(probes.select(*by, F.col("bound").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["node"].dataType).alias("node"), "probe"))
    order = [F.desc("__at"), F.asc("__kind"), F.desc_nulls_last("node")]
    found = Ranges(both, order, by).latest(F.col("node"), "__found").frame()
    return found.where("__kind = 1").select(*by, "probe", F.col("__at").alias("bound"), F.col("__found").alias("node"))


def throttled(events: DataFrame, least: float, by=("key",)) -> DataFrame:
    """``by, node, step`` of the events (by, node, value) that are kept: a group's first, then each first one that is ``least`` or more behind the last kept.
    Nodes are numbers that grow with the value."""
    by = list(by)
    nexts = first_at_least(events, events.select(*by, F.col("node").alias("probe"), (F.col("value") + least).alias("bound")), by)
    return reached(nexts.select(*by, F.col("probe").alias("node"), F.col("node").alias("next")), events.groupBy(*by).agg(F.min("node").alias("node")), by)
