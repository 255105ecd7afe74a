"""What all operators share: the shared folder of the cluster, bounded broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of at most 64 bytes each that one broadcast may hold (some tens of MB on an executor).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master (tests) gets a
    temporary folder; on a cluster that would be one machine's own, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-shared-")
        shared_dir.own = where
    return where.rstrip("/")


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, so a lost executor costs no earlier stage.
    Results are lazy, so what they were made from stays in that folder; the cluster clears it like other checkpoints.

    With `by` it is shuffled once, here, into as many buckets of that column as spark.sql.shuffle.partitions says; joins on it
    then leave these rows where they are. Bucketed files can be written as a table only, whose name goes again at once.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        n = min(int(spark.conf.get(f"spark.sql.{k}")) for k in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
        as_table = f"spark_catalog.default.stored_{name}"
        df.repartition(n, by).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(as_table)
        out = spark.table(as_table)
        spark.sql(f"DROP TABLE {as_table}")  # an external table: its files stay
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote for these tables, which nothing reads any more: all that was made from them is stored."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files go as soon as the write that they were made for is done, not when the driver happens to
    collect its garbage, which may be after all of a large run's files have come together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Holds this session's Arrow batches to Python workers to so many bytes, where Spark's default (64 MB) still stands:
    a worker holds several times a batch, beside its neighbour's, in what the JVM leaves of an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, size)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def join_hot(rows: DataFrame, found: DataFrame, on: list[str], count: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined (inner or left) with found, which has one row for each value of `on` and, in `count`, how many of rows have that value.

    Values that more than 1 / share of the rows have (fewer than `share` such values there can be) are broadcast, so their
    rows stay where they are; the rest is shuffled. Both sides are read twice and should be stored.
    """
    most = max(10_000, rows.count() // share)
    hot = F.broadcast(found.where(F.col(count) > most))
    cold = rows.join(hot.select(*on), on, "left_anti").join(found.where(F.col(count) <= most), on, how)
    return rows.join(hot, on).unionByName(cold)


def first_by_hash(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Up to `most` distinct (doc_id, by) of each value of `by`, those first by a hash of doc_id: doc_id, by, order.

    Null ids and values are left out. Ids whose hash is above twice what the number of ids of their value asks for go
    where they are read, so however many rows a value has, few of them are shuffled to where the first are chosen. There
    must be few values (languages, labels): their counts are broadcast.
    """
    d = rows.where(F.col("doc_id").isNotNull() & F.col(by).isNotNull()).select("doc_id", by)
    share = d.groupBy(by).agg((F.lit(2.0 * most) / F.approx_count_distinct("doc_id", 0.02)).alias("share"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = d.withColumn("order", order).join(F.broadcast(share), by).where(F.col("order") / float(1 << 40) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("order", "doc_id"))
    return near.select("doc_id", by, "order").distinct().withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node, root being its component's least node.

    Large-star and small-star steps in turn until no edge changes; each is a min over a node's edges, which are a pair of
    ids each and spill where they are many. Edges with a null end are left out, loops and repeated edges count once. Fails if `rounds` don't suffice (they grow with the
    logarithm of a component's diameter).
    """
    e = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before, near = None, Window.partitionBy("a")
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(near))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        to = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = stored(large.withColumn("m", F.min("b").over(near)).select(to.alias("x")).select("x.*").where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: {rounds} rounds don't suffice")
    e = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return e.union(e.select(F.col("root").alias("node"), "root").distinct())
