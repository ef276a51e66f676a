"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers (256 times the entry, floored).  Counts and sums
of the distinct vectors are exact; the covariance is centred before it is
multiplied, in one pass of small matrices that Spark sums by cell.  What
reaches the driver has the size of the covariance, not of the table: it is
brought to tridiagonal form by Householder reflections, the leading
eigenvalues come from bisection on Sturm counts, their vectors from inverse
iteration, with those of close eigenvalues made orthogonal to each other.
The components go back to the tasks, which project every row.

Defined cases: a null vector, or one with null, NaN or infinite entries, is
dropped; a vector shorter than the longest counts as padded with zeros, and a
table without entries gives no rows; a null or repeated ``vec_id`` is a row
of its own; a component without variance (all vectors equal, or fewer
dimensions than components) has no rows; a deviation beyond a long is null;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, importable, lists, written

SCALE = 256
COMPONENTS = 4
#: Vectors that are multiplied together.
BLOCK = 4096


# ------------------------------------------------------- symmetric eigenvectors
def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a tridiagonal matrix similar to
    the symmetric ``a``."""
    a, n, reflectors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += np.copysign(np.sqrt(x @ x), x[0])
        norm = v @ v
        v = v * np.sqrt(2 / norm) if norm > 0 else np.zeros_like(v)
        # (I - vv')A(I - vv') on the trailing block
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - v * (p @ v) / 2
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = x - v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal (d, e) below each of ``x``."""
    tiny = np.finfo(float).tiny ** 0.5
    q = d[0] - x
    below = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] * e[i - 1] / q
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bit."""
    n = len(d)
    radius = np.abs(np.concatenate([e, [0]])) + np.abs(np.concatenate([[0], e]))
    lo, hi = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    pad = np.finfo(float).eps * max(abs(lo[0]), abs(hi[0])) * n
    lo, hi = lo - pad, hi + pad
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        left = sturm_count(d, e, mid) > rank
        hi, lo = np.where(left, mid, hi), np.where(left, lo, mid)
    return lo + (hi - lo) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - shift I) x = b by elimination with row exchanges."""
    n, x = len(d), b.copy()
    main, up, up2 = d - shift, np.concatenate([e, [0.0]]), np.zeros(n)
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(main[i]):
            factor = main[i] / low
            main[i], (main[i + 1], up[i]) = low, (up[i] - factor * main[i + 1], main[i + 1])
            up2[i], up[i + 1] = up[i + 1], -factor * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            factor = low / main[i]
            main[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        main[i] = main[i] if abs(main[i]) > tiny else tiny
        x[i] = (x[i] - up[i] * (x[i + 1] if i + 1 < n else 0) - up2[i] * (x[i + 2] if i + 2 < n else 0)) / main[i]
        if abs(x[i]) > 1e200:
            x /= abs(x[i])
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; vectors of a cluster of
    close eigenvalues are made orthogonal to each other in every round."""
    n = len(d)
    norm = np.abs(d).max() + 2 * np.abs(np.concatenate([e, [0]])).max()
    close, tiny = 1e-3 * norm, np.finfo(float).eps * max(norm, np.finfo(float).tiny)
    out, cluster, shift = np.empty((len(values), n)), 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close:
            cluster = i
        shift = min(value, shift - 10 * tiny) if i > cluster else value  # equal eigenvalues get shifts of their own
        x = np.random.default_rng(i).standard_normal(n)
        for _ in range(rounds):
            for _ in range(2):
                x -= out[cluster:i].T @ (out[cluster:i] @ x)
            x = _solve(d, e, shift, x / np.sqrt(x @ x), tiny)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[cluster:i].T @ (out[cluster:i] @ x)
        out[i] = x / np.sqrt(x @ x)
    return out


def components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``cov`` that are above
    zero, falling, and their unit eigenvectors as rows."""
    n, scale = len(cov), np.abs(cov).max(initial=0.0)
    if not scale:
        return np.empty(0), np.empty((0, n))
    d, e, reflectors = householder(cov / scale)
    values = leading_eigenvalues(d, e, min(k, n))
    vectors = leading_vectors(d, e, values)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        vectors[:, j + 1:] -= np.outer(vectors[:, j + 1:] @ v, v)
    real = values > n * np.finfo(float).eps * values[0] * 4
    return values[real] * scale, vectors[real]


# ------------------------------------------------------------------ Spark side
def _entries(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch of one dimension as a matrix."""
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array<bigint>, of one length) of the usable rows."""
    rows = vectors.where("embedding IS NOT NULL").selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS c")
    finite = rows.where("forall(c, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))")
    return finite.selectExpr("vec_id", f"transform(c, v -> floor(v * {float(scale)}D)) AS x")


def _cells(matrix: np.ndarray, n: int):
    """Rows (i, values) of a task's matrix, the count in row -1."""
    m = len(matrix)
    flat = np.concatenate([[n], matrix.ravel()])
    return batches_of({"i": np.arange(-1, m, dtype=np.int32), "v": lists(flat, np.concatenate([[0], 1 + np.arange(m + 1) * matrix.shape[1]]))},
                      pa.schema([("i", pa.int32()), ("v", pa.list_(pa.from_numpy_dtype(flat.dtype)))]))


def _summed(rows: DataFrame, task, kind: str, shape: tuple[int, int]) -> tuple[int, np.ndarray]:
    """(count, matrix): the sum over tasks of the matrices that ``task`` makes
    of its batches.  Spark sums cell by cell; the driver gets one matrix."""
    cells = rows.mapInArrow(task, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    n, out = 0, np.zeros(shape, np.int64 if kind == "bigint" else np.float64)
    for r in cells.collect():
        if r["i"] < 0:
            n = int(r["v"])
        else:
            out[r["i"], r["j"]] = r["v"]
    return n, out


def _sums(dims: int):
    """Sums of the entries in two halves, so that no partial sum overflows."""
    def run(batches):
        n, s = 0, np.zeros((2, dims), np.int64)
        for b in batches:
            x = _entries(b)
            s += (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            n += b.num_rows
        yield from _cells(s, n)
    return run


def _products(mean: np.ndarray, project: np.ndarray | None = None):
    """Sums of the products of centred vectors, or of their projections with
    the sums of these in the last row."""
    def run(batches):
        m = len(mean) if project is None else len(project) + 1
        n, out = 0, np.zeros((m, m))
        for b in batches:
            x = _entries(b)
            for lo in range(0, len(x), BLOCK):
                c = x[lo:lo + BLOCK] - mean
                if project is not None:
                    c = np.column_stack([c @ project.T, np.ones(len(c))])
                out += c.T @ c
            n += b.num_rows
        yield from _cells(out, float(n))
    return run


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                  ("explained", pa.float64()), ("identity_error", pa.float64())])


def _project(n: int, sums: list[int], mean: np.ndarray, project: np.ndarray, explained: np.ndarray, error: float):
    k, dims, most = len(project), len(sums), max(map(abs, sums))

    def deviation(x: np.ndarray) -> pa.Array:
        wide = n * max(abs(int(x.max())), abs(int(x.min()))) + most
        if wide * wide * dims < 1 << 63:
            off = n * x - np.array(sums)
            return pa.array((off * off).sum(axis=1))
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches):
        for b in batches:
            x = _entries(b)
            if not len(x):
                continue
            each = np.repeat(np.arange(len(x)), k)
            take = pa.array(each)
            yield from batches_of({"vec_id": b.column("vec_id").take(take), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                                   "n": np.full(len(each), n), "deviation": deviation(x).take(take), "whitened": ((x - mean) @ project.T).ravel(),
                                   "explained": np.tile(explained, len(x)), "identity_error": np.full(len(each), error)}, _OUT)
    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of
    every usable row of ``vectors`` (vec_id, embedding) and component."""
    importable(vectors.sparkSession)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = written(whole_numbers(vectors, scale), "vectors")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    if rows.agg(F.min(F.size("x"))).first()[0] != dims:
        rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("x"))).alias("x"))
    fit = written(rows.select("x").distinct(), "distinct")
    n, halves = _summed(fit, _sums(dims), "bigint", (2, dims))
    sums = [(high << 32) + low for high, low in halves.T.tolist()]
    mean = np.array([s / n for s in sums])
    cov = _summed(fit, _products(mean), "double", (dims, dims))[1] / n
    cov = (cov + cov.T) / 2
    values, vectors_ = components(cov, k)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    project = vectors_ / np.sqrt(values)[:, None]
    m = len(values)
    products = _summed(fit, _products(mean, project), "double", (m + 1, m + 1))[1] / n
    white = products[:m, :m] - np.outer(products[m, :m], products[m, :m])
    error = float(np.abs(white - np.eye(m)).max())
    return rows.mapInArrow(_project(n, sums, mean, project, values / np.trace(cov), error), schema)
