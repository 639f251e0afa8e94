"""Exact top-k search by inner product: columnar branch-and-bound.

Components x become ``floor(SCALE * x)``, so scores are whole numbers and exact. Dimensions are put in falling order of their mass (the
sum of squares over all vectors) and in blocks of ``WIDTH``. A task has a bounded part of the candidates in vertical layout, a column for each
dimension, and a bounded part of the queries. Scores are added up block by block; after each, what is still to come is at most the
sum over later blocks of the product of both sides' norms there, and a pair that can't reach the query's threshold any more goes. While
many pairs are left, a block is one matrix product; once less than ``SPARSE`` of them are, the survivors are compacted to a list of pairs and
only those are added to.

A query's threshold is a score that k other rows are known to reach: first the k-th best among a pilot of ``PILOT`` rows (a bounded sample, taken by hash:
it only sets the threshold, all rows are candidates), then the k-th best that the task has seen. Pairs on the threshold stay, as ties go
to the smaller id. The best k of every task meet in a ranking by query, which Spark cuts to k rows before the shuffle, too.

Candidates are dealt by a hash of their row number to ``parts`` groups of at most about ``CANDIDATES``, queries to groups of ``QUERIES``; a cell of the
grid of groups is one task's work. Copies of a vector spread over all groups like other rows.

Defined results: vectors that are null, hold null or non-finite components, or values beyond ``LARGEST`` take no part, nor do vectors of another length than most (ties:
the longer). A row is never its own candidate; other rows of the same id or vector are. Ties go to the smaller id, null ids last, then either row. A query
with fewer others gets them all. Queries of equal id are ranked each by itself."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

SCALE = 64
LARGEST = 1 << 24
WIDTH = 8
SPARSE = 0.125
PILOT = 4096
#: Of a task: candidates at most and, unless that makes too many groups, at least; queries at most.
CANDIDATES, FEW, GROUPS = 1 << 16, 1 << 10, 48
QUERIES = 1 << 13
#: Of a tile, what is added up at a time.
TILE = (256, 4096)
#: Margin of the bound over the rounding of norms.
MARGIN = 1 + 1e-9


class Vertical:
    """Vectors with a column for each dimension, and the norm of each block of dimensions."""

    def __init__(self, x: np.ndarray, order: np.ndarray, kind: type):
        self.columns = np.ascontiguousarray(x[:, order].T).astype(kind)
        self.starts = np.arange(0, max(1, len(order)), WIDTH)
        squares = np.add.reduceat(self.columns.astype(np.float64) ** 2, self.starts, axis=0) if len(order) else np.zeros((1, len(x)))
        self.norms = np.sqrt(squares)

    def part(self, a: int, b: int) -> "Vertical":
        out = object.__new__(Vertical)
        out.columns, out.starts, out.norms = self.columns[:, a:b], self.starts, self.norms[:, a:b]
        return out


def survivors(q: Vertical, c: Vertical, threshold: np.ndarray, same: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and exact score of all pairs that reach the query's threshold, but for the pairs ``same``."""
    blocks, nq, nc = len(c.starts), q.columns.shape[1], c.columns.shape[1]
    score = np.zeros((nq, nc), q.columns.dtype)
    least = threshold[:, None]
    for b in range(blocks):
        at = slice(c.starts[b], c.starts[b] + WIDTH)
        score += q.columns[at].T @ c.columns[at]
        to_come = q.norms[b + 1 :].T @ c.norms[b + 1 :]
        alive = score + to_come * MARGIN >= least
        alive[same] = False
        if b == blocks - 1 or np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    i, j = np.nonzero(alive)
    s = score[i, j]
    for b in range(b + 1, blocks):
        at = slice(c.starts[b], c.starts[b] + WIDTH)
        s = s + np.einsum("dp,dp->p", q.columns[at, i], c.columns[at, j])
        to_come = np.einsum("dp,dp->p", q.norms[b + 1 :, i], c.norms[b + 1 :, j])
        stay = s + to_come * MARGIN >= threshold[i]
        i, j, s = i[stay], j[stay], s[stay]
    return i, j, s


def best(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, order: np.ndarray, k: int, kind: type, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of each query's k best candidates that reach its threshold. Of equal scores, earlier candidates come first."""
    by_row = np.argsort(c_row, kind="stable")
    whole, out = Vertical(c, order, kind), []
    for a in range(0, len(q), TILE[0]):
        rows, some = q_row[a : a + TILE[0]], Vertical(q[a : a + TILE[0]], order, kind)
        least = threshold[a : a + TILE[0]].copy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        # where each query is among the candidates
        place = np.searchsorted(c_row[by_row], rows)
        own = np.full(len(rows), -1)
        there = np.flatnonzero(place < len(c_row))
        hit = there[c_row[by_row[place[there]]] == rows[there]]
        own[hit] = by_row[place[hit]]
        for b in range(0, len(c), TILE[1]):
            inside = np.flatnonzero((own >= b) & (own < b + TILE[1]))
            i, j, s = survivors(some, whole.part(b, b + TILE[1]), least, (inside, own[inside] - b))
            i, j, s = (np.concatenate(x) for x in zip(found, (i, j + b, s), strict=True))
            by_score = np.lexsort((j, -s, i))
            i, j, s = i[by_score], j[by_score], s[by_score]
            first = np.searchsorted(i, np.arange(len(rows)))
            stay = np.arange(len(i)) - first[i] < k
            i, j, s = found = i[stay], j[stay], s[stay]
            full = np.bincount(i, minlength=len(rows)) == k
            first = np.searchsorted(i, np.arange(len(rows)))
            least[full] = np.maximum(least[full], s[first[full] + k - 1])
        out.append((found[0] + a, found[1], found[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in column]) if len(column) else np.zeros((0, dims), np.int32)


def _ready(vectors: DataFrame, queries: Column, id_col: str, vector: str) -> DataFrame:
    """``row, id, asks, x`` of the vectors that take part, in the shared folder: row numbers stay when a task runs again."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST / SCALE))
    found = vectors.where(F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound, F.lit(False)))
    size = found.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    found = found.where(F.size(v) == (size["d"] if size else 0)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), v.alias("v"))

    def whole(batches):
        for batch in batches:
            v = batch.column("v")
            flat = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int32).reshape(len(v), -1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("asks"), pa.array([x.tobytes() for x in flat], pa.binary())], ["row", "id", "asks", "x"])

    schema = T.StructType(list(found.schema.fields[:3])).add("x", "binary")
    return materialise(found.mapInArrow(whole, schema), "top-k")


def _masses(ready: DataFrame, dims: int) -> tuple[int, np.ndarray, int]:
    """Number of vectors, sum of squares by dimension and largest value: sums of tasks, added up by dimension."""

    def work(batches):
        n, mass, top = 0, np.zeros(dims), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            n, mass, top = n + len(x), mass + (x * x).sum(0), np.maximum(top, np.abs(x).max(0, initial=0).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(mass), pa.array(top)], ["i", "n", "mass", "top"])

    rows = ready.select("x").mapInArrow(work, "i int, n long, mass double, top long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.max("top").alias("top")).collect()
    return rows[0]["n"], np.array([r["mass"] for r in sorted(rows)]), max(r["top"] for r in rows)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", pilot: int = PILOT) -> DataFrame:
    """``query_id, rank, <id_col>, score``: of every row for which ``queries`` holds, the k other rows of highest inner product."""
    spark = vectors.sparkSession
    ready = _ready(vectors, queries, id_col, vector)
    kind_of_id = ready.schema["id"].dataType
    out = T.StructType().add("asked", "long").add("query_id", kind_of_id).add("row", "long").add("id", kind_of_id).add("score", "long")
    first = ready.select(F.length("x")).first()
    dims = first[0] // 4 if first else 0
    asking = ready.where("asks").select("row", "id", "x")
    n_asking = asking.count() if dims else 0
    if n_asking:
        n, mass, top = _masses(ready, dims)
        order = np.argsort(-mass, kind="stable")
        # sums of products below 2**53 are exact as doubles
        kind = np.float64 if top * top * dims < 1 << 53 else np.int64
        # no more than PILOT rows come to the driver and go into tasks
        sample = ready.orderBy(F.xxhash64("row"), "row").limit(min(pilot, PILOT)).select("row", "x").collect()
        p_row, p = np.array([r["row"] for r in sample], np.int64), np.array([np.frombuffer(r["x"], np.int32) for r in sample], np.int32).reshape(len(sample), dims)

        def thresholds(batches):
            for batch in batches:
                q, row = _matrix(batch.column("x"), dims), batch.column("row").to_numpy()
                least = np.full(len(q), -np.inf)
                i, _, s = best(q, row, p, p_row, order, k, kind, least)
                full = np.bincount(i, minlength=len(q)) == k
                least[full] = s[np.searchsorted(i, np.flatnonzero(full)) + k - 1] if full.any() else 0
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("x"), pa.array(least)], ["row", "id", "x", "least"])

        schema = T.StructType(list(asking.schema.fields)).add("least", "double")
        asking = materialise(asking.mapInArrow(thresholds, schema), "queries")
        groups = max(-(-n // CANDIDATES), min(GROUPS, -(-n // FEW)))
        slices = -(-n_asking // QUERIES)
        dealt = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = ready.select("row", "id", "x", dealt(groups, 1).alias("g"), every(slices).alias("h"))
        right = asking.select("row", "id", "x", "least", dealt(slices, 2).alias("h"), every(groups).alias("g"))

        def cell(c: pa.Table, q: pa.Table) -> pa.Table:
            c = c.take(pc.sort_indices(c, [("id", "ascending"), ("row", "ascending")]))
            x, y = _matrix(c["x"], dims), _matrix(q["x"], dims)
            i, j, s = best(y, q["row"].to_numpy(), x, c["row"].to_numpy(), order, k, kind, q["least"].to_numpy())
            i, j = pa.array(i), pa.array(j)
            return pa.table({"asked": q["row"].take(i), "query_id": q["id"].take(i), "row": c["row"].take(j), "id": c["id"].take(j), "score": pa.array(s.astype(np.int64))})

        found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(cell, out)
    else:
        found = spark.createDataFrame([], out)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
