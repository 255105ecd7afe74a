"""Tables of companies that are replaced company by company and published at once.

A table is a folder: data/<write>/bucket=<n>/ holds Parquet files of the companies whose hash is n, sorted by company;
manifests/<version>.json names the folder of each bucket. A version is there once its manifest is, so readers see a write
whole or not at all, and a writer that is killed leaves only files that no manifest names (see vacuum).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of a new table, and rows of one file at most.
BUCKETS, FILE_ROWS = 64, 5_000_000


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the newest by default) consists of: version, buckets (their number), schema, folders (of each bucket
    that has rows), marks (what writers recorded); None where there is none."""
    found = versions(spark, path)
    if not found:
        return None
    text = spark.read.text(f"{path}/manifests/{found[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, entry: dict) -> None:
    """Writes a manifest aside and renames it, which fails if the version is there already."""
    fs, to = _files(spark, f"{path}/manifests/{entry['version']:012d}.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, to, none)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{path}: version {entry['version']} was published by another writer") from e
        raise


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, m: dict, some: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    folders = [f"{path}/{f}" for b, f in m["folders"].items() if some is None or int(b) in some]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, path: str, key: str = "slug", only: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest by default) of a table; only: of one company, whose bucket alone is read."""
    m = manifest(spark, path, version)
    if m is None:
        raise FileNotFoundError(f"{path} holds no published version")
    if only is None:
        return _read(spark, path, m)
    bucket = spark.range(0, 1, 1, 1).select(bucket_of(F.lit(only), m["buckets"]).alias("b")).first().b
    return _read(spark, path, m, [bucket]).where(F.col(key) == only)


def replace_companies(rows: DataFrame, companies: DataFrame, path: str, key: str = "slug", order: tuple[str, ...] = (), buckets: int = BUCKETS, mark: tuple[str, int] | None = None, tries: int = 5, before_publish: Callable[[], None] | None = None) -> int:
    """Publishes a version of the table at path in which the companies given have these rows (none: they are gone) and all
    others the rows that they had; returns its number.

    Only buckets of the companies given are read and written; rows of other companies among `rows` are left out, as are those
    without a company. Sorted by company and `order`, a file's statistics tell where a company is. `buckets` counts for a new table only. If another writer
    publishes first, the merge is done again on what it published, up to `tries` times. mark: a name and number to record
    with the version (see marked). Columns must be those that the table has.
    """
    given = companies.select(key).where(F.col(key).isNotNull()).distinct().persist()  # only names; often made from the rows themselves
    try:
        return _replace(rows, given, path, key, order, buckets, mark, tries, before_publish)
    finally:
        given.unpersist()


def _replace(rows: DataFrame, given: DataFrame, path: str, key: str, order: tuple[str, ...], buckets: int, mark: tuple[str, int] | None, tries: int, before_publish: Callable[[], None] | None) -> int:
    spark = rows.sparkSession
    for _ in range(tries):
        m = manifest(spark, path) or {"version": 0, "buckets": buckets, "schema": json.loads(rows.schema.json()), "folders": {}, "marks": {}}
        if {c.lower() for c in rows.columns} != {f["name"].lower() for f in m["schema"]["fields"]}:
            raise ValueError(f"{path} has the columns {[f['name'] for f in m['schema']['fields']]}, not {rows.columns}")
        bucket = bucket_of(F.col(key), m["buckets"])
        touched = {r.b for r in given.select(bucket.alias("b")).distinct().collect()}  # at most as many as there are buckets
        own = rows.join(given, key, "left_semi").select([f["name"] for f in m["schema"]["fields"]])
        rest = _read(spark, path, m, sorted(touched)).join(given, key, "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        merged = rest.unionByName(own).withColumn("bucket", bucket).repartition(len(touched) or 1, "bucket").sortWithinPartitions("bucket", key, *order)
        merged.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{path}/{folder}")
        here = {n.partition("=")[2] for n in _names(spark, f"{path}/{folder}") if n.startswith("bucket=")}
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in here}
        entry = m | {"version": m["version"] + 1, "folders": folders, "marks": m["marks"] | dict([mark] if mark else [])}
        if before_publish:
            before_publish()
        try:
            _publish(spark, path, entry)
            return entry["version"]
        except Conflict:
            continue
    raise Conflict(f"{path}: another writer published first {tries} times")


def marked(spark: SparkSession, path: str, name: str) -> int:
    """The number last recorded under a name in a table's newest version, -1 if none was."""
    m = manifest(spark, path)
    return m["marks"].get(name, -1) if m else -1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all versions but the newest `keep`, and data that none of these names; returns what was removed. Not to be run
    while someone writes."""
    old = versions(spark, path)[:-keep] if keep else []
    stay = {f for v in versions(spark, path)[-keep:] for f in manifest(spark, path, v)["folders"].values()}
    gone = [f"manifests/{v:012d}.json" for v in old]
    for write in _names(spark, f"{path}/data"):
        parts = [f"data/{write}/{n}" for n in _names(spark, f"{path}/data/{write}") if n.startswith("bucket=")]
        left = [p for p in parts if p not in stay]
        gone += left if len(left) < len(parts) else [f"data/{write}"]
    for name in gone:
        fs, where = _files(spark, f"{path}/{name}")
        fs.delete(where, True)
    return gone
