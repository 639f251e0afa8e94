"""Whitening of vectors by their leading principal components, found by matrix-free block subspace iteration.

Components x of a vector become ``floor(SCALE * x) + SHIFT``, whole numbers, so that sums are exact. The vectors are packed once, some thousand to
a row, and each pass over them gives ``C Q`` for the covariance C and a block Q of ``BLOCK`` times k orthonormal directions, as the sum of
``Xᵀ(XQ)`` over centred rows X: C itself is never formed, and what a task returns and the driver holds is of the size of Q. A pass
ends with Rayleigh-Ritz: ``Qᵀ(C Q)`` gives eigenvalues and vectors within the block and, with no further pass, the residuals ``|C z - e z|``.
Until those of the first k certify all k vectors, the block goes through a Chebyshev polynomial of C that is small below the block's least
value and large above (three-term recurrence, a pass for each degree), then QR. The degree is bounded so that the block keeps its rank
in doubles. Plain iteration would need about twice the passes; the fixed points are the same.

Defined results: vectors that are null, hold null or non-finite components, or components of ``2**52 / SCALE`` and more take no part, nor do vectors of
another length than most (ties: the longer). Components are numbered by falling eigenvalue; of equal ones any basis is right. At most as many
as dimensions are found. A direction without variance (below ``FLAT`` of the trace) has no scale: ``whitened`` is null, and ``explained`` is too where the trace
is 0. Sums of squares beyond a long are null. Repeated rows count as often as they come; ids may be null, of any type, or repeat."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, small_batches

SCALE, SHIFT = 1024, 100000
#: Directions in the block for each component wanted: the more, the fewer passes.
BLOCK = 4
#: A residual relative to the largest eigenvalue that certifies a component.
CERTIFIED = 1e-13
#: Where rounding alone keeps residuals from falling on, they may be this large.
ROUNDING = 1e-11
#: Passes after which the iteration gives up.
PASSES = 3000
#: The largest degree of the polynomial, and how much more the first component may grow than the last in it.
DEGREE, SPREAD = 8, 1e8
FLAT = 1e-13
#: Components of all vectors in a packed row.
PACKED = 1 << 17


class Model(NamedTuple):
    dims: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def fit_list(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float(2**52 // SCALE)))
    found = vectors.where(F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound, F.lit(False)))
    size = found.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size(v) == (size["d"] if size else 0))


def _whole(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors as rows of whole numbers."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def packed(vectors: DataFrame, vector: str) -> DataFrame:
    """``n, x``: so many vectors as eight-byte whole numbers, row by row, in the shared folder."""

    def work(batches):
        for batch in batches:
            x = _whole(batch.column(0))
            step = max(1, PACKED // max(1, x.shape[1]))
            parts = [x[i : i + step] for i in range(0, len(x), step)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "x"])

    return materialise(vectors.select(vector).mapInArrow(work, "n int, x binary"), "vectors")


def _sums(blocks: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    def work(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            for x in batch.column("x"):
                x = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dims)
                n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total)], ["i", "n", "s"])

    with small_batches(blocks.sparkSession, rows=8):
        rows = blocks.mapInArrow(work, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return rows[0]["n"] if rows else 0, np.array([r["s"] for r in sorted(rows)], np.int64)


def _product(blocks: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: ``Xᵀ(XQ)`` and the sum of squares over all rows, centred. What moves is a row for each dimension and task."""
    dims, width = q.shape

    def work(batches):
        total, squares = np.zeros((dims, width)), 0.0
        for batch in batches:
            for x in batch.column("x"):
                x = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dims) - mean
                total += x.T @ (x @ q)
                squares += float(np.vdot(x, x))
        columns = [pa.array(range(dims), pa.int32()), pa.array([squares] + [0.0] * (dims - 1)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "squares", *(f"c{j}" for j in range(width))])

    columns = ["squares", *(f"c{j}" for j in range(width))]
    with small_batches(blocks.sparkSession, rows=8):
        rows = blocks.mapInArrow(work, "i int, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).collect()
    table = np.array([r[1:] for r in sorted(rows)])
    return np.ascontiguousarray(table[:, 1:]), float(table[:, 0].sum())


def _degree(values: np.ndarray, cut: float, k: int) -> int:
    growth = [t + np.sqrt(t * t - 1) for t in (max(1.0, 2 * v / cut - 1) for v in (values[0], values[k - 1]))]
    ratio = np.log(growth[0] / growth[1])
    return DEGREE if ratio * DEGREE <= np.log(SPREAD) else max(1, int(np.log(SPREAD) / ratio))


def fit(blocks: DataFrame, dims: int, k: int, seed: int = 0) -> Model:
    """The first k components of packed vectors."""
    n, sums = _sums(blocks, dims)
    k = min(k, dims)
    if not n:
        return Model(dims, 0, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0, 0.0, 0)
    mean, passes = sums / n, 0

    def covariance(q):
        nonlocal passes
        passes += 1
        y, squares = _product(blocks, mean, q)
        return y / n, squares / n

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, min(dims, BLOCK * k))))[0]
    best, still = np.inf, 0
    while True:
        y, trace = covariance(q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        z, cz = q @ turn, y @ turn
        residual = float(np.linalg.norm(cz - z * values, axis=0)[:k].max())
        still = 0 if residual < best / 2 else still + 1
        best, top = min(best, residual), max(float(values[0]), 0.0)
        if residual <= CERTIFIED * top or still >= 3 and residual <= ROUNDING * top or top == 0:
            break
        if passes > PASSES:
            raise RuntimeError(f"residual {residual / top:.2g} after {passes} passes")
        cut = float(values[-1])
        if cut <= FLAT * top:  # less variance outside the block than rounding: a plain step
            q = np.linalg.qr(cz)[0]
            continue
        before, now = z, 2 / cut * cz - z
        for _ in range(_degree(values, cut, k) - 1):
            before, now = now, 2 * (2 / cut * covariance(now)[0] - now) - before
        q = np.linalg.qr(now)[0]
    values, z = values[:k], z[:, :k]
    full = values > FLAT * trace
    w = z[:, full] / np.sqrt(values[full])
    error = float(np.abs(w.T @ covariance(w)[0] - np.eye(w.shape[1])).max()) if w.shape[1] else 0.0
    return Model(dims, n, sums, values, z, trace, residual, error, passes)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of ``(n * x - S)**2`` for each row, exact; None beyond a long."""
    if not len(x):
        return []
    top = n * int(np.abs(x).max()) + int(np.abs(sums).max())
    if top < 2**63:
        gap = n * x - sums
        if int(np.abs(gap).max()) ** 2 * x.shape[1] < 2**63:
            return (gap * gap).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: ``id, component, n, deviation, whitened, explained, identity_error``."""
    rows = fit_list(vectors, vector).select(F.col(id_col).alias("__id"), F.col(vector).alias("__v"))
    first = rows.select(F.size("__v")).first()
    dims = first[0] if first else 0
    out = T.StructType([T.StructField("__id", rows.schema["__id"].dataType)]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not dims:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("__id", id_col)
    m = fit(packed(rows, "__v"), dims, k)
    full = m.values > FLAT * m.trace
    scaled, mean, k = m.components * np.where(full, 1 / np.sqrt(np.where(full, m.values, 1)), np.nan), m.sums / m.n, len(m.values)
    explained = (m.values / m.trace).tolist() if m.trace else [None] * k

    def work(batches):
        for batch in batches:
            x = _whole(batch.column("__v"))
            if not len(x):
                continue
            white = ((x - mean) @ scaled).ravel()
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("__id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n, np.int64)),
                pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(each), m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, out).withColumnRenamed("__id", id_col)
