"""Whitening of embeddings by one-sided Jacobi on the R factor of a blockwise TSQR.

Entries become whole numbers, so sums and deviations are exact. Rows of the fit list are centred before anything is
multiplied; every task reduces its rows to one triangle R by QR factorisations of blocks, triangles are stacked and
factorised again over a tree, so no task holds more than some hundred of them. Plane rotations then orthogonalise R's
columns: their product holds the components, the columns' lengths the standard deviations. R has as many columns as a
vector has entries, whatever the number of rows, and is the only thing that is decomposed on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import give_back, stored

#: Entries are bounded by this after rounding, so that sums of a batch fit into 64 bits.
MOST = 1 << 46


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns.

    Columns are rotated in disjoint pairs, every pair once a sweep, until all are orthogonal to working precision.
    """
    d = r.shape[1]
    odd = d % 2
    u = np.column_stack([r, np.zeros((len(r), odd))]).astype(float)
    size = d + odd
    v, order = np.eye(size), np.arange(size)
    for _ in range(sweeps):
        turned = False
        for _ in range(size - 1):
            p, q = order[: size // 2], order[size // 2 :][::-1]
            a, b, c = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            turn = np.abs(c) > 1e-15 * np.sqrt(a) * np.sqrt(b)
            if turn.any():
                turned = True
                p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
                with np.errstate(over="ignore"):  # an endless z is no turn
                    z = (b - a) / (2 * c)
                    t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                for m in (u, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = cos * left - sin * right, sin * left + cos * right
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    length = np.sqrt((u[:, :d] ** 2).sum(0))
    down = np.argsort(-length, kind="stable")
    return length[down], v[:d, :d][:, down]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums without rounding, as 64-bit integers or, where those could overflow, as Python's."""
    if not len(x) or n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array([s if abs(s) < 1 << 62 else 0 for s in sums], np.int64)
    return x.astype(object) * n - np.array(sums, object)


def triangles(fit: DataFrame, d: int, n: int, sums: list[int]) -> DataFrame:
    """(part int, r array<double>): the R factor of the centred rows ``x`` of each task, reduced over a tree to one row at most."""

    def shrink(blocks):
        r = np.zeros((0, d))
        for m in blocks:
            r = np.linalg.qr(np.concatenate([r, m]), mode="r")
        return r

    def local(batches):
        r = shrink((apart(_matrix(b.column("x"), d), n, sums) / n).astype(float) for b in batches if len(b))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])
        give_back()

    def merge(table):
        parts = [x.values.to_numpy(zero_copy_only=False).reshape(-1, d) for x in table.column("r")]
        r = shrink(parts)
        return pa.table({"part": table.column("part").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    out = fit.mapInArrow(local, "part int, r array<double>")
    for groups in (1024, 32, 1):
        out = out.withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(merge, "part int, r array<double>")
    return out


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length than the
    most common (of two, the longer). An entry c becomes floor(64 * c) + 1000000, bounded at 2**46 beyond which embeddings
    don't reach. Each different vector counts once in the fit; repeated rows are returned each. Null keys are kept, other
    columns ignored. deviation is the exact sum over the entries of (n * x - S)**2, null where a long can't hold it.
    Components of no variance to working precision aren't returned: less than ``components`` for few different vectors,
    none for one. Empty in, empty out.
    """
    v = F.col(column)
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & usable).select(F.col(key).alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c.cast("double") * 64, F.lit(-float(MOST))), F.lit(float(MOST)))) + 1_000_000)
    rows = rows.where(F.size("v") == d).select("vec_id", whole.alias("x"))
    fit = stored(rows.select("x").distinct())
    n = fit.count()

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(_matrix(b.column("x"), d).sum(0))], names=["i", "s"])

    found = fit.mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * d
    for r in found:
        sums[r["i"]] = int(r["s"])
    mean = np.array([s / max(n, 1) for s in sums])
    top = triangles(fit, d, max(n, 1), sums).first()
    r = np.array(top["r"]).reshape(-1, d) if top else np.zeros((1, d))
    length, axes = jacobi(r)
    k = int((length[:components] > length[0] * d * np.finfo(float).eps * 8).sum()) if length[0] > 0 else 0
    axes, deviations = axes[:, :k], length[:k] / np.sqrt(max(n, 1))
    explained = length[:k] ** 2 / max((length**2).sum(), 1e-300)
    project = axes / deviations

    def moments(batches):
        for b in batches:
            w = (_matrix(b.column("x"), d) - mean) @ project
            both = np.concatenate([w.sum(0)[None], w.T @ w])
            at = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel().astype(np.int32)), pa.array(at[1].ravel().astype(np.int32)), pa.array(both.ravel())], names=["i", "j", "s"])

    both = np.zeros((k + 1, k))
    for i, j, s in fit.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        both[i, j] = s / n
    error = float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(k)).max()) if k else 0.0

    def deviation(x):
        y = apart(x, n, sums)
        if not len(y) or y.dtype != object and float(np.abs(y).max()) ** 2 * d < 2.0**62:
            return pa.array((y * y).sum(1).astype(np.int64))
        squares = [sum(int(c) ** 2 for c in row) for row in y]
        return pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())

    schema = rows.select("vec_id").schema.add("component", T.IntegerType()).add("n", T.LongType()).add("deviation", T.LongType())
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.add(name, T.DoubleType())

    def rotate(batches):
        for b in batches:
            for at in range(0, len(b) if k else 0, 2048):
                part = b.slice(at, 2048)
                m, x = len(part), _matrix(part.column("x"), d)
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation(x).take(row),
                    pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            give_back()

    return rows.mapInArrow(rotate, schema)
