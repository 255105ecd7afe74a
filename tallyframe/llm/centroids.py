"""Clustering of integer vectors by Lloyd's algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import stored

#: Components of at most this size have squared distances that fit in 64 bits; beyond, Python's integers are used.
FAST = 1 << 27


def finite(v: Column) -> Column:
    """Whether an array is there and none of its entries is null, not a number or infinite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id and x, the components as integers floor(scale * component), of the vectors (vec_id, embedding) with exactly
    `dim` components, none of them null or not finite, or so large that it is no 62-bit integer."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(finite(F.col("v")) & (F.size("v") == dim) & F.forall("v", lambda c: F.abs(c) * scale < float(1 << 62)))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared differences of each vector and each centroid, summed; integers of any size where need be."""
    kind = np.int64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= FAST and x.shape[1] <= 64 else object
    out = np.empty((len(x), len(centroids)), kind)
    for j, c in enumerate(centroids.astype(kind)):
        d = x.astype(kind) - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(np.int64) if len(x) else np.zeros((0, 0), np.int64)


def _chunks(p: pd.DataFrame, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(p), rows):
        yield p.iloc[lo : lo + rows]


def partial_sums(centroids: np.ndarray):
    """A task's vectors by nearest centroid (ties: the lower number), as (cluster, dimension, sum); dimension -1: their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for p in (c for b in batches for c in _chunks(b)):
            x = _matrix(p["x"])
            to = np.argmin(squared_distances(x, centroids), axis=1)
            small = np.abs(x).max(initial=0) < 1 << 48  # so that 10,000 of them fit in 64 bits
            for j in np.unique(to).tolist():
                own = x[to == j]
                count[j] += len(own)
                total[j] += (own if small else own.astype(object)).sum(axis=0).astype(object)
        at = np.flatnonzero(count)
        if len(at):
            sums = np.column_stack([count[at].astype(object), total[at]])
            yield pd.DataFrame({"cluster": np.repeat(at, dim + 1), "i": np.tile(np.arange(-1, dim), len(at)), "total": [Decimal(int(v)) for v in sums.ravel()]})

    return run


def lloyd(vectors: DataFrame, start: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Centroids after so many rounds from `start` on, over vectors (x: array<long>): each vector counts for its nearest
    centroid, and each centroid that has any becomes the floor of their mean in each dimension."""
    c = start
    for _ in range(rounds):
        sums = vectors.select("x").mapInPandas(partial_sums(c), "cluster int, i int, total decimal(38,0)")
        sums = sums.groupBy("cluster", "i").agg(F.sum("total").alias("total")).collect()  # one row for each component
        of = {(r.cluster, r.i): int(r.total) for r in sums}
        c = np.array([[of[j, i] // of[j, -1] for i in range(c.shape[1])] if (j, -1) in of else c[j].tolist() for j in range(len(c))], np.int64)
    return c


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Each usable vector's cluster and squared distance from its centroid (vec_id, cluster, distance), and the centroids.

    See integer_vectors for what is usable and how components become integers; all arithmetic is exact. The first
    centroids are the k vectors whose sha256 of "seed:vec_id" is least (ties, as of a repeated vec_id: the lesser vector;
    fewer vectors than k: each is one). Nulls of vec_id give no first centroid but are clustered like others; repeated
    rows count each. A distance that no 64-bit integer holds is null. Other columns aren't read; no rows give no rows.

    Centroids travel with each round's tasks; what comes back to the driver is k * (dim + 1) sums.
    """
    v = stored(integer_vectors(vectors, dim, scale))
    first = v.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    start = np.array([r.x for r in first.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(start):
        return v.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), start
    c = lloyd(v, start, rounds)

    @F.pandas_udf("cluster int, distance long")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = [squared_distances(_matrix(x.iloc[lo : lo + 10_000]), c) for lo in range(0, len(x), 10_000)]
        to = [np.argmin(m, axis=1) for m in d]
        least = [v if v < 1 << 63 else None for m, t in zip(d, to) for v in m[np.arange(len(m)), t].tolist()]
        return pd.DataFrame({"cluster": np.concatenate(to) if to else [], "distance": pd.array(least, "Int64")})

    return v.select("vec_id", nearest("x").alias("y")).select("vec_id", "y.*"), c


def with_inertia(clustered: DataFrame) -> DataFrame:
    """clustered (vec_id, cluster, distance) and the sums of distance over its cluster and over all, as cluster_inertia
    and inertia; null where a distance is, or where no 64-bit integer holds the sum."""
    d = F.col("distance").cast("decimal(38,0)")
    sums = clustered.groupBy("cluster").agg(F.sum(d).alias("total"), F.max(F.col("distance").isNull()).alias("over")).collect()  # one row for each cluster
    whole = lambda rows: F.lit(total) if (total := sum(int(r.total or 0) for r in rows)) < 1 << 63 and not any(r.over for r in rows) else F.lit(None)
    own = F.lit(None).cast("long")
    for r in sums:
        own = F.when(F.col("cluster") == r.cluster, whole([r]).cast("long")).otherwise(own)
    return clustered.withColumn("cluster_inertia", own).withColumn("inertia", whole(sums).cast("long"))
