"""Whitening of embeddings: exact centred scatter, cyclic Jacobi rotations, and the projection on every vector."""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.centroids import finite
from tallyframe.llm.shared import stored

#: Components times `scale` must be below this, so that sums of products of any number of them fit in 38 digits.
MOST = 1 << 40
#: An eigenvalue of less than this share of the greatest is rounding, not spread: no component.
RANK = 1e-13


@dataclass
class Whitening:
    dim: int
    n: int  # distinct vectors
    sums: list[int]  # of each dimension over them
    trace: float
    values: np.ndarray  # eigenvalues, falling, of the components kept
    vectors: np.ndarray  # their unit eigenvectors, as rows


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    Each sweep goes through all entries above the diagonal, row by row, and rotates each to zero that isn't negligible
    beside the geometric mean of its two diagonal entries; that measure, and not the size of the whole matrix, is what keeps small
    eigenvalues accurate. It ends with a sweep without any rotation.
    """
    a, n = a.astype(np.float64).copy(), len(a)
    v, tiny = np.eye(n), np.finfo(np.float64).eps / 4
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if x == 0 or abs(x) <= tiny * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                pp, qq = a[p, p] - t * x, a[q, q] + t * x
                for m in (a, v):
                    mp, mq = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
                a[p, :], a[q, :] = a[:, p], a[:, q]
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
        if not turned:
            return np.diag(a).copy(), v
    raise RuntimeError(f"jacobi: {sweeps} sweeps don't suffice")


def quantised(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x, floor(scale * component) + shift, of the vectors (vec_id, embedding) without null or non-finite
    components, or such whose product with scale is MOST or more."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(finite(F.col("v")) & (F.size("v") > 0) & F.forall("v", lambda c: F.abs(c) * scale < float(MOST)))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(np.int64)


def scatter_parts(center: np.ndarray, rows: int = 4096):
    """A task's sums of products of components less `center`, exactly: (i, j, total) for i <= j, and i = -1 for sums of
    the components less center themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first = None, None
        for b in batches:
            for lo in range(0, len(b), rows):
                y = _matrix(b["x"].iloc[lo : lo + rows]) - center
                # doubles hold the products' sums as long as those are below 2^53; else Python's integers do
                m = y.astype(np.float64) if int(np.abs(y).max()) ** 2 * len(y) < 1 << 53 else y.astype(object)
                part, sums = (m.T @ m), m.sum(axis=0)
                if m.dtype != object:
                    part, sums = part.astype(np.int64), sums.astype(np.int64)
                total = part.astype(object) if total is None else total + part
                first = sums.astype(object) if first is None else first + sums
        if total is not None:
            i, j = np.triu_indices(len(center))
            i, j = np.append(i, np.full(len(center), -1)), np.append(j, np.arange(len(center)))
            yield pd.DataFrame({"i": i, "j": j, "total": [decimal.Decimal(int(first[b] if a < 0 else total[a, b])) for a, b in zip(i.tolist(), j.tolist())]})

    return run


def fit_whitening(distinct: DataFrame, dim: int, most: int = 16) -> Whitening:
    """The components of the distinct vectors (x) of `dim` dimensions: eigenvectors of their covariance, divisor n.

    Two passes: exact sums, then the scatter about the means. Vectors are centred on the means rounded to integers, so that
    products add up exactly whatever the order of tasks; what rounding left, less than half in a dimension, is then taken
    out as the exact product of the remaining sums, so the covariance is that of exactly centred vectors, rounded once.
    """
    n, *sums = distinct.select(F.count("*"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(dim)]).first()
    sums = [int(s) for s in sums]
    center = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    parts = distinct.select("x").mapInPandas(scatter_parts(center), "i int, j int, total decimal(38,0)")
    of = {(r.i, r.j): int(r.total) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}  # dim * (dim + 3) / 2 sums
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = float(Fraction(n * of[i, j] - of[-1, i] * of[-1, j], n * n))
    values, vectors = jacobi(cov)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(RANK * values.max(), 0.0)][:most]
    rows = vectors[:, order].T
    sign = np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])
    return Whitening(dim, n, sums, float(np.trace(cov)), values[order], rows * sign[:, None])


def project(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Vectors (rows of integers) on the components, each over the root of its eigenvalue."""
    n, center = model.n, np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % n for s in model.sums], np.float64) / n
    return ((x - center).astype(np.float64) - rest) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n * x - sum)^2 of each vector, exactly; None where no 64-bit integer holds it."""
    d = x.astype(object) * model.n - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """The largest entry of the difference of the whitened vectors' covariance and the identity, over all distinct vectors."""
    k = len(model.values)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for lo in range(0, len(b), 4096):
                w = project(model, _matrix(b["x"].iloc[lo : lo + 4096]))
                m = w.mean(axis=0)
                off = m - mean
                spread += (w - m).T @ (w - m) + np.outer(off, off) * (n * len(w) / (n + len(w)))
                mean, n = mean + off * len(w) / (n + len(w)), n + len(w)
        if n:
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pd.DataFrame({"i": i, "j": j, "spread": spread.ravel(), "outer": np.outer(mean, mean).ravel() * n, "sum": np.repeat(mean * n, k)})

    s = distinct.select("x").mapInPandas(parts, "i int, j int, spread double, outer double, sum double")
    got = s.groupBy("i", "j").agg(F.sum("spread").alias("spread"), F.sum("outer").alias("outer"), F.sum("sum").alias("sum")).collect()
    mean = {r.i: r.sum / model.n for r in got}
    return max((abs((r.spread + r.outer) / model.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in got), default=0.0)


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Every usable vector (vec_id, embedding) on the components of greatest spread: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error.

    Components become integers (see quantised for which vectors are usable and how); the fit takes each distinct integer
    vector once, n of them. whitened is the vector less the means, projected on a unit eigenvector of their covariance,
    over the root of its eigenvalue; explained is that eigenvalue's share of the trace. deviation is the exact sum over
    dimensions of (n * x - sum)^2, null where no 64-bit integer holds it. identity_error is measured over the whitened
    distinct vectors. Eigenvectors are signed so that their largest entry is positive.

    Vectors of each length are whitened by themselves. Components without spread (an eigenvalue that is only rounding)
    can't be whitened and are left out, so a single distinct vector gives no rows. Repeated rows and null vec_ids give rows
    like others; null and empty vectors none; other columns aren't read. No rows give no rows.
    """
    v = quantised(vectors, scale, shift)
    distinct = stored(v.select("x").distinct())
    out = None
    for size in sorted(r.d for r in distinct.select(F.size("x").alias("d")).distinct().collect()):  # lengths of vectors, few
        own = distinct.where(F.size("x") == size)
        model = fit_whitening(own, size, most)
        if len(model.values):
            one = _whitened(v.where(F.size("x") == size), model, identity_error(model, own))
            out = one if out is None else out.unionByName(one)
    if out is not None:
        return out
    return v.select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).where("false")


def _whitened(v: DataFrame, model: Whitening, error: float) -> DataFrame:
    @F.pandas_udf("deviation long, w array<double>")
    def apply(x: pd.Series) -> pd.DataFrame:
        m = _matrix(x) if len(x) else np.zeros((0, model.dim), np.int64)
        return pd.DataFrame({"deviation": pd.array(deviations(model, m), "Int64"), "w": list(project(model, m))})

    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = v.select("vec_id", apply("x").alias("y")).select("vec_id", F.col("y.deviation").alias("deviation"), F.posexplode("y.w").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
