"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import join_hot, stored

#: Centroids of each half: the root of the number of entries, so cells of about one, up to the second number; then this
#: power of it, up to the last. Smaller cells leave more entries unvisited but take more steps of the heap (pairs' sizes are a
#: table on the driver and in each task: 0.5 MB at most).
CENTROID_POWER, CENTROIDS = 0.4, (8, 64, 256)
#: Vectors to fit the centroids on at most, queries to calibrate with, and vectors and queries that meet in one task.
FIT_ROWS, CALIBRATION_QUERIES, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 64, 20_000, 4_000
#: Queries whose cells one task looks up.
QUERIES_TASK = 500


@dataclass
class MultiIndex:
    dim: int
    first: np.ndarray  # centroids of the first halves
    second: np.ndarray
    cells: np.ndarray  # entries in each pair of centroids
    budget: int  # entries to traverse for a query


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (own := to == j).any():
                c[j] = x[own].mean(axis=0)
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def traverse(query: np.ndarray, index: MultiIndex, budget: float) -> np.ndarray:
    """For each cell (first by second half) that a query visits the entries visited before it; -1 for the others.

    Pairs of centroids are taken in falling order of the summed inner products with the query's halves, by a heap over
    the two sorted lists, until they hold `budget` entries. Cells without entries aren't visited.
    """
    half = index.dim // 2
    a, b = index.first @ query[:half], index.second @ query[half:]
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b = (-a[ia]).tolist(), (-b[ib]).tolist()
    cells, wide = index.cells[np.ix_(ia, ib)].ravel().tolist(), len(b)
    seen: list[int] = []
    before: list[int] = []
    heap, got = [(a[0] + b[0], 0)], 0
    while heap and got < budget:
        at = heap[0][1]
        n = cells[at]
        if n:
            seen.append(at)
            before.append(got)
            got += n
        i, j = divmod(at, wide)
        if j + 1 < wide:
            heapq.heapreplace(heap, (a[i] + b[j + 1], at + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], at + wide))
    out = np.full(index.cells.shape, -1, np.int64)
    i, j = np.divmod(np.array(seen, np.int64), wide)
    out[ia[i], ib[j]] = before
    return out


def _matrix(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v: the vector as doubles) that take part: neither null, empty, zero, nor with null or non-finite
    components."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _bytes(v: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(x, np.float64).tobytes() for x in v])


def fit_index(entries: DataFrame, n: int, dim: int, k: int, half_centroids: int | None, recall: float, fit_rows: int, calibration: int) -> MultiIndex:
    """Centroids from about fit_rows of the n entries (vec_id, raw), the first by a hash of the id; cell sizes over all
    entries; and the least traversal budget whose mean recall of the k nearest, over up to `calibration` entries taken as
    queries and measured against every entry, is at least `recall` (above 1: all entries)."""
    order = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    near = entries.where(order < int(min(1.0, 1.5 * fit_rows / max(1, n)) * (1 << 40)))  # so that few are compared
    rows = near.select("vec_id", "raw").orderBy(order, "vec_id").limit(fit_rows).collect()
    x = np.frombuffer(b"".join(r.raw for r in rows), np.float64).reshape(-1, dim)
    half = dim // 2
    wide = half_centroids or int(np.clip(round(min(n**0.5, max(CENTROIDS[1], n**CENTROID_POWER))), CENTROIDS[0], CENTROIDS[2]))
    first, second = kmeans(x[:, :half], wide), kmeans(x[:, half:], wide)
    index = MultiIndex(dim, first, second, np.zeros((len(first), len(second)), np.int64), 0)
    queries, ids = x[:calibration].copy(), np.array([r.vec_id for r in rows[:calibration]])
    del rows, x

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's cell sizes (q = -1), and its k nearest entries for each query."""
        cells, best = np.zeros(len(first) * len(second), np.int64), None
        for p in batches:
            m = _matrix(p["raw"], dim)
            cell = assign(m[:, :half], first) * len(second) + assign(m[:, half:], second)
            cells += np.bincount(cell, minlength=len(cells))
            s = queries @ m.T
            s[ids[:, None] == p["vec_id"].to_numpy()] = -np.inf
            s, c = (s, np.broadcast_to(cell, s.shape)) if best is None else (np.hstack([best[0], s]), np.hstack([best[1], np.broadcast_to(cell, s.shape)]))
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        if best is not None:
            at = np.flatnonzero(cells)
            yield pd.DataFrame({"q": -1, "cell": at, "n": cells[at], "score": 0.0})
            q = np.repeat(np.arange(len(queries)), best[0].shape[1])
            yield pd.DataFrame({"q": q, "cell": best[1].ravel(), "n": 1, "score": best[0].ravel()})

    seen = stored(entries.mapInPandas(measure, "q int, cell long, n long, score double"))
    for r in seen.where("q = -1").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        index.cells[r.cell // len(second), r.cell % len(second)] = r.n
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    truth = seen.where("q >= 0 and score > double('-infinity')").withColumn("rank", rank).where(F.col("rank") <= k).select("q", "cell").collect()
    of = np.array([(r.q, r.cell) for r in truth], np.int64).reshape(-1, 2)
    # a true neighbour is found if fewer entries than the budget are visited before its cell
    reached = np.sort(np.concatenate([traverse(q, index, np.inf).ravel()[of[of[:, 0] == i, 1]] for i, q in enumerate(queries)]))
    index.budget = max(min(n, 2 * k), int(reached[int(np.ceil(recall * len(reached))) - 1]) + 1) if len(reached) and recall <= 1 else n
    return index


def units(cells: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of first-half centroids that hold about block_rows entries, as each centroid's run and each run's first
    centroid, and how many parts a run is cut into: one, but for a centroid that alone holds more."""
    run, first, parts, held = np.zeros(len(cells), np.int32), [], [], 0
    for c, n in enumerate(cells.sum(axis=1).tolist()):
        if not first or held + n > block_rows:
            first.append(c)
            parts.append(max(1, -(-n // block_rows)))
            held = 0
        held += n
        run[c] = len(first) - 1
    return run, np.array([*first, len(cells)]), np.array(parts)


def nearest(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", k: int = 20, half_centroids: int | None = None, recall: float = 0.95, fit_rows: int = FIT_ROWS, calibration: int = CALIBRATION_QUERIES, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) by inner product, for each row that queries_where selects (a
    condition on vec_id).

    Returns query_id, rank (from 1; ties of score: the smaller vec_id first), vec_id, score; rows of a query's own id are
    no neighbours of it. Vectors are quantised by halves, by a number of centroids that grows with the number of entries unless it is
    given; a query visits the pairs of centroids with the highest summed inner products until they hold a number of
    entries that was calibrated for `recall`, and those are scored in double precision. Vectors null, empty, zero, or with
    null or non-finite components take no part, as do null ids; vectors of each length have an index of their own (lengths
    must be few). Other columns are not read. Repeated rows (same id and vector) count once. No rows give no rows.

    Of equal vectors only the k + 1 with the smallest ids are entries (no query needs more), and equal queries are
    searched once, so a vector that very many rows share costs no more than others. A query whose id other vectors have
    too is searched by itself, without any of these, which are added to the entries that it visits. Entries meet queries by runs of
    first-half centroids in blocks of bounded size; a query travels once to each block that it visits a cell of. All
    entries are indexed; fewer than k found means that fewer exist.
    """
    v = usable(vectors).select("vec_id", F.pandas_udf(_bytes, "binary")("v").alias("raw"))
    v = stored(v.withColumn("h", F.md5("raw")).dropDuplicates(["vec_id", "h"]))
    out = None
    for size in sorted(r.n for r in v.select(F.length("raw").alias("n")).distinct().collect()):
        one = _nearest(v.where(F.length("raw") == size), size // 8, queries_where, k, half_centroids, recall, fit_rows, calibration, block_rows, block_queries)
        out = one if out is None else out.unionByName(one)
    return v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")) if out is None else out


def _nearest(v: DataFrame, dim: int, queries_where: str, k: int, half_centroids: int | None, recall: float, fit_rows: int, calibration: int, block_rows: int, block_queries: int) -> DataFrame:
    """`nearest` over vectors (vec_id, raw, h) of one length."""
    spark = v.sparkSession
    copy = F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))
    entries = stored(v.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "raw"))
    index = fit_index(entries, entries.count(), dim, k, half_centroids, recall, fit_rows, calibration)
    half = dim // 2
    run, begins, e_parts = units(index.cells, block_rows)

    asked = v.where(queries_where)
    versions = stored(asked.groupBy("vec_id").agg(F.count("*").alias("versions")).where("versions > 1"))
    alone = F.col("versions").isNotNull()
    asked = join_hot(asked, versions, ["vec_id"], "versions", "left")
    asked = stored(asked.withColumn("name", F.when(alone, F.concat_ws(":", "h", "vec_id")).otherwise(F.col("h"))))
    distinct = asked.groupBy("name").agg(F.min("raw").alias("raw"), F.max(F.coalesce("versions", F.lit(0))).alias("versions"), F.max(F.when(alone, F.col("vec_id")).otherwise(0)).alias("own"))
    distinct = distinct.repartition(max(1, -(-asked.count() // QUERIES_TASK)))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = _matrix(p["raw"], dim)
            c1, c2 = assign(m[:, :half], index.first), assign(m[:, half:], index.second)
            yield pd.DataFrame({"run": run[c1], "c1": c1, "c2": c2, "vec_id": p["vec_id"], "raw": p["raw"]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each run of which a query visits a cell: which of the run's cells, as bits."""
        for p in batches:
            for lo in range(0, len(p), 500):
                out = []
                for name, raw, versions, own in p[["name", "raw", "versions", "own"]].iloc[lo : lo + 500].itertuples(index=False):
                    cells = traverse(np.frombuffer(raw, np.float64), index, index.budget + versions) >= 0
                    for u in np.unique(run[cells.any(axis=1)]).tolist():
                        out.append((u, np.packbits(cells[begins[u] : begins[u + 1]]).tobytes(), name, raw, versions > 0, own))
                yield pd.DataFrame(out, columns=["run", "bits", "name", "raw", "alone", "own"])

    placed = entries.mapInPandas(locate, "run int, c1 int, c2 int, vec_id long, raw binary")
    visits = stored(distinct.mapInPandas(visit, "run int, bits binary, name string, raw binary, alone boolean, own long"))
    # bounded blocks: of a run's entries by id, of its queries by hash; each query block meets each entry block
    many = {r.run: r.n for r in visits.groupBy("run").agg(F.count("*").alias("n")).collect()}
    parts = [(u, int(n), max(1, -(-many.get(u, 0) // block_queries))) for u, n in enumerate(e_parts.tolist())]
    parts = F.broadcast(spark.createDataFrame(parts, "run int, e_parts int, q_parts int"))  # a row for each centroid at most
    left = placed.join(parts, "run").withColumn("e", F.pmod(F.xxhash64("vec_id"), F.col("e_parts")).cast("int"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("run", "e", "q", "c1", "c2", "vec_id", "raw")
    right = visits.join(parts, "run").withColumn("q", F.pmod(F.xxhash64("name"), F.col("q_parts")).cast("int"))
    right = right.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("e_parts") - 1))).select("run", "e", "q", "bits", "name", "raw", "alone", "own")

    def score(p: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out, width = [], len(index.second)
        if len(p) and len(asks):
            p = p.sort_values(["c1", "vec_id"], ignore_index=True)
            begin = begins[p["run"].iloc[0]]
            m, c1, c2, ids = _matrix(p["raw"], dim), p["c1"].to_numpy() - begin, p["c2"].to_numpy(), p["vec_id"].to_numpy()
            at = np.searchsorted(c1, np.arange(c1[-1] + 2))
            names, x = asks["name"].to_numpy(), _matrix(asks["raw"], dim)
            alone, not_id = asks["alone"].to_numpy(), asks["own"].to_numpy()
            for lo in range(0, len(asks), 256):
                bits = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in asks["bits"].iloc[lo : lo + 256]])
                found = []  # of each centroid's entries the k + 1 nearest of the visited
                for c in range(len(at) - 1):
                    seen = bits[:, c * width : (c + 1) * width]
                    ask, some = np.flatnonzero(seen.any(axis=1)), slice(at[c], at[c + 1])
                    if len(ask) and at[c] < at[c + 1]:
                        s = x[lo + ask] @ m[some].T
                        s[seen[ask][:, c2[some]] == 0] = -np.inf
                        if alone[lo + ask].any():
                            s[alone[lo + ask][:, None] & (not_id[lo + ask][:, None] == ids[some])] = -np.inf
                        most = min(k + 1, s.shape[1])
                        low = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
                        q, e = np.nonzero((s >= low - 1e-9 * np.abs(low)) & (s > -np.inf))
                        found.append((ask[q], at[c] + e))
                if found:
                    q, e = (np.concatenate(f) for f in zip(*found))
                    s = (x[lo + q] * m[e]).sum(axis=1)  # each pair by itself, so that equal vectors tie
                    order = np.lexsort((ids[e], -s, q))
                    q, e, s = q[order], e[order], s[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    q, e, s = q[rank <= k], e[rank <= k], s[rank <= k]
                    out.append(pd.DataFrame({"name": names[lo + q], "vec_id": ids[e], "score": s}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"name": [], "vec_id": [], "score": []}).astype({"vec_id": "int64", "score": "float64"})

    hits = left.groupBy("run", "e", "q").cogroup(right.groupBy("run", "e", "q")).applyInPandas(score, "name string, vec_id long, score double")
    near = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))
    hits = hits.withColumn("rank", near).where(F.col("rank") <= k + 1).select("name", "vec_id", "score")
    lists = hits.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("found"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "name").join(lists, "name")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    out = answers.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.low")).alias("score"))
