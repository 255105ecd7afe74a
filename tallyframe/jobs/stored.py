"""Queries that write what is derived and read it back: readers, writers, publication, and the incremental refresh.

Companies here are the nations, each with an income statement by market segment for each year of its orders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import sources, streaming
from tallyframe.jobs import derive
from tallyframe.operators import checking, compiling, filings

#: Long rows of the nations' reports, as derive.CELLS: a report states its year and the one before, a hundred above what
#: that one's own report stated. Every third nation has no revenue line.
NATION_CELLS = """
WITH o AS (
  SELECT replace(lower(n_name), ' ', '-') AS slug, n_nationkey, year(o_orderdate) AS y, c_mktsegment AS seg, CAST(o_totalprice AS DECIMAL(18,2)) AS v
  FROM {orders} AS ord JOIN {customer} AS cus ON o_custkey = c_custkey JOIN {nation} AS nat ON c_nationkey = n_nationkey
), s AS (
  SELECT slug, y, seg AS label, CAST(floor(sum(v)) AS DOUBLE) AS v FROM o GROUP BY slug, y, seg
  UNION ALL SELECT slug, y, 'Revenue', CAST(floor(sum(v)) AS DOUBLE) FROM o WHERE n_nationkey % 3 <> 0 GROUP BY slug, y
), k AS (SELECT 0 AS k UNION ALL SELECT 1)
SELECT slug, CAST(y + k AS INT) AS report_year, 'income' AS kind, label AS rank, label, 'line' AS row_kind, CAST(y AS INT) AS period_year, v + k * 100 AS value FROM s CROSS JOIN k
"""
#: Reports up to this year come first, the others later and, where a query replaces some companies, only for those whose names come before "nation_2".
FIRST = 1996


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir; a local master without it gets a
    temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-stored-")
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}"


def nation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation")}
    return derive.as_reports(spark.sql(NATION_CELLS, **given), range(2))


def _by_file(df: DataFrame, kind: str, path: str) -> None:
    """One JSON file for each report, in a folder of the file's name."""
    name = F.concat(F.col("slug"), F.lit("-"), F.col("report_year").cast("string"), F.lit(f".{kind}.json"))
    df.withColumn("file", name).drop("slug", "report_year").repartition("file").write.option("ignoreNullFields", False).partitionBy("file").json(path)


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p["text"])
    path = scratch(spark)
    _by_file(derive.report_pages(spark, sf_dir).groupBy("slug", "report_year").agg(F.max("report_year").alias("year"), pages.alias("pages")), "pages", path)
    p = sources.read_pages(spark, f"{path}/*/*.json")
    return p.select("slug", "report_year", "page_index", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


def _pivoted(reports: DataFrame) -> DataFrame:
    one = F.struct("periods", "rows")
    kinds = [F.max(F.when(F.col("kind") == k, one)).alias(k) for k in ("income", "balance", "cashflow")]
    return reports.groupBy("slug", "report_year").agg(F.max("report_year").alias("year"), *kinds)


def _shown(reports: DataFrame) -> DataFrame:
    figures = F.array_join(F.transform("x.values", lambda v: F.coalesce(F.floor(v).cast("string"), F.lit("-"))), ",")
    r = reports.select("slug", "report_year", "kind", F.array_join("periods", ",").alias("periods"), F.posexplode_outer("rows").alias("pos", "x"))
    return r.select("slug", "report_year", "kind", "periods", F.coalesce("pos", F.lit(-1)).alias("pos"), "x.label", figures.alias("figures"))


def reports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _by_file(_pivoted(nation_reports(spark, sf_dir)), "extracted", path)
    return _shown(sources.read_reports(spark, f"{path}/*/*.json"))


def reports_unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sources.unpivot_statements(_pivoted(derive.reports(spark, sf_dir))))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.filing_links(spark, sf_dir).groupBy("slug", (F.col("page_ord") % 20 + 2000).cast("int").alias("year")).agg(F.min("href").alias("url"))


def discovered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    entry = F.struct(F.concat_ws(":", "slug", F.col("year").cast("string")), "url")
    maps = _links(spark, sf_dir).groupBy("slug").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.repartition("slug").write.partitionBy("slug").text(path)
    return sources.read_discovered(spark, f"{path}/*")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = derive.filing_links(spark, sf_dir)
    return filings.catalog_filings(links, links.select("slug").distinct().select("slug", F.array("slug").alias("hosts")))


def catalog_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = scratch(spark), _filings(spark, sf_dir)
    sources.write_catalog(c, path)
    sources.write_catalog(c.where("slug like '%a%'").withColumn("title", F.concat(F.lit("new "), F.col("title"))), path)
    return sources.read_filings(spark, path).select("slug", "url", "title")


def filings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.filter_filings(_filings(spark, sf_dir), "Annual Report").select("slug", "url", "type")


def _two_writes(spark: SparkSession, sf_dir: str, write) -> None:
    """Every nation from its first reports, then some again, from all of theirs."""
    r = nation_reports(spark, sf_dir)
    for part in (r.where(F.col("report_year") <= FIRST), r.where("slug < 'nation_2'")):
        c = compiling.compile_statements(part, markers=True)
        issues = checking.validate(c)
        write(c.where("key is not null"), issues, checking.validation_status(issues, part), part)


def statements_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write is strict, so companies that fail keep what they had."""
    path, writes = scratch(spark), []
    none = spark.createDataFrame([], "slug string, year int, url string")

    def write(c: DataFrame, issues: DataFrame, status: DataFrame, r: DataFrame) -> None:
        writes.append(sources.write_statements(c, sources.source_list(r, none), status, path, strict=bool(writes)))

    _two_writes(spark, sf_dir, write)
    s = sources.read_statements(spark, path).select("slug", "status", "key", F.size("sources").alias("n_sources"), F.inline(F.arrays_zip("periods", "values")))
    return s.select("slug", "status", "key", "n_sources", F.col("periods").cast("int").alias("period_year"), "values").withColumnRenamed("values", "value")


def validation_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _two_writes(spark, sf_dir, lambda c, issues, status, r: sources.write_validation(issues, status, path))
    return sources.read_validation(spark, path).select("slug", "status", F.size("issues").alias("n_issues"))


def _cells(compiled: DataFrame) -> DataFrame:
    return compiled.select("slug", "key", "period_year", "value", "restated", "historical")


def one_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nation_reports(spark, sf_dir)
    return _cells(compiling.compile_statements(sources.filter_companies(r, "nation_7")))


def display_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = compiling.compile_wide(derive.reports(spark, sf_dir))
    return compiling.with_places(w).select("slug", "kind", "key", "historical", "place")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that come in two lots, each taken by one run of the stream."""
    path, r = scratch(spark), nation_reports(spark, sf_dir)
    where = [f"{path}/{n}" for n in ("incoming", "reports", "compiled", "checkpoint")]
    for lot in (F.col("report_year") > FIRST, F.col("report_year") <= FIRST):
        r.where(lot).write.mode("append").parquet(where[0])
        streaming.refresh_incremental(spark, *where, buckets=8)
    return _cells(sources.read_published(spark, where[2]))


QUERIES = [pages_read, reports_read, reports_unpivoted, discovered_read, catalog_published, filings_filtered, statements_published, validation_published, one_company, display_places, refreshed]
