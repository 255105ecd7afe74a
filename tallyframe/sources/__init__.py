"""Reading and writing page texts, extracted reports, filings and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.compiling import ROWS, to_wide
from tallyframe.sources.publishing import BUCKETS, read_published, replace_companies

STATEMENT = f"struct<periods:array<string>,rows:{ROWS}>"
#: A report's file, or a folder of its name (as a writer partitioned by "file" makes them) with files in it.
NAME = r"(?:/|^)(?:file=)?([^/]+)-([0-9]{4})\.(?:pages|extracted)\.json(?:/[^/]+)?$"


def _named(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, NAME, 1).alias("slug"), F.regexp_extract(path, NAME, 2).try_cast("int").alias("report_year"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page-text files <slug>-<year>.pages.json, {year, pages}: slug, report_year, page_index, text."""
    p = _named(spark.read.schema("year int, pages array<string>").option("multiLine", True).json(path))
    return p.select("slug", "report_year", F.posexplode("pages").alias("page_index", "text"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Extracted reports <slug>-<year>.extracted.json as reports: a row for each kind, empty where a file lacks it."""
    kinds = ["income", "balance", "cashflow"]
    r = _named(spark.read.schema(", ".join(["year int", *[f"{k} {STATEMENT}" for k in kinds]])).option("multiLine", True).json(path))
    return unpivot_statements(r, kinds)


def unpivot_statements(reports: DataFrame, kinds: tuple | list = ("income", "balance", "cashflow")) -> DataFrame:
    """slug, report_year and a struct column for each kind as a row for each kind."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.periods").alias("periods"), F.col(f"{k}.rows").alias("rows")) for k in kinds])
    e = reports.select("slug", "report_year", F.explode(parts).alias("x"))
    empty = lambda t: F.array().cast(t)
    return e.select("slug", "report_year", "x.kind", F.coalesce("x.periods", empty("array<string>")).alias("periods"), F.coalesce("x.rows", empty(ROWS)).alias("rows"))


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of "slug:year" to url: slug, year, url."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "url"))
    part = F.split("key", ":")
    return m.select(F.get(part, F.lit(0)).alias("slug"), F.get(part, F.lit(1)).try_cast("int").alias("year"), "url")


def read_filings(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """The catalogue as published, of all companies or one."""
    return read_published(spark, path, only=slug)


def read_statements(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """Wide statements as published by write_statements, of all companies or one."""
    return read_published(spark, path, only=slug)


def read_validation(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """slug, status and issues as published by write_validation, of all companies or one."""
    return read_published(spark, path, only=slug)


def write_statements(compiled: DataFrame, sources: DataFrame, status: DataFrame, path: str, strict: bool = False, dry_run: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Publishes the wide statements of each company in compiled or status, with its sources; other companies keep theirs.

    A company without a row left has none any more. strict withholds companies whose status is fail: they keep what they
    had. Returns what is (or, on a dry run, would be) written. See publishing for how others see it.
    """
    wide = to_wide(compiled)
    companies = compiled.select("slug").union(status.select("slug"))
    if strict:
        failed = status.where("status = 'fail'").select("slug")
        wide, companies = wide.join(failed, "slug", "left_anti"), companies.join(failed, "slug", "left_anti")
    urls = sources.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("report_year", "url")), asc=False).alias("sources"))
    out = wide.join(urls, "slug", "left").join(status.groupBy("slug").agg(F.max("status").alias("status")), "slug", "left")
    if not dry_run:
        replace_companies(out, companies, path, order=("kind", "historical", "ord"), buckets=buckets)
    return out


def write_validation(issues: DataFrame, status: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Publishes slug, status and issues for each company in status; other companies keep theirs."""
    rows = issues.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("check", "severity", "period_year", "expected", "actual", "diff"))).alias("issues"))
    none = F.array().cast("array<struct<check:string,severity:string,period_year:int,expected:double,actual:double,diff:double>>")
    out = status.groupBy("slug").agg(F.max("status").alias("status")).join(rows, "slug", "left").select("slug", "status", F.coalesce("issues", none).alias("issues"))
    replace_companies(out, status, path, buckets=buckets)


def write_catalog(filings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Publishes the catalogue of each company in filings; other companies keep theirs. However many companies there are, a
    write makes no more files than buckets (but for such of more than FILE_ROWS rows)."""
    replace_companies(filings, filings, path, order=("ord",) if "ord" in filings.columns else (), buckets=buckets)


def source_list(reports: DataFrame, discovered: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The URL of each report: slug, report_year, url (of the registry, else discovered, else '')."""
    r = reports.select("slug", "report_year").distinct()
    named = lambda df, c: df.groupBy("slug", F.col("year").alias("report_year")).agg(F.max("url").alias(c))
    r = r.join(named(discovered, "found"), ["slug", "report_year"], "left")
    first = F.lit(None).cast("string")
    if registry is not None:
        r, first = r.join(named(registry, "listed"), ["slug", "report_year"], "left"), F.col("listed")
    return r.select("slug", "report_year", F.coalesce(first, "found", F.lit("")).alias("url"))


def filter_years(df: DataFrame, years: str | None, column: str = "report_year") -> DataFrame:
    """Rows of a range such as "2015-2025", both ends included; all for None."""
    if not years:
        return df
    lo, dash, hi = years.partition("-")
    if not (dash and len(lo) == len(hi) == 4 and lo.isdigit() and hi.isdigit()):
        raise ValueError("years must look like 2015-2025")
    return df.where(F.col(column).between(int(lo), int(hi)))


def filter_companies(companies: DataFrame, slug: str | None = None) -> DataFrame:
    """One company, or all; an unknown slug is an error."""
    if slug is None:
        return companies
    one = companies.where(F.col("slug") == slug)
    if one.isEmpty():
        raise ValueError(f"unknown company: {slug}")
    return one


def company_lookup(df: DataFrame, companies: DataFrame) -> DataFrame:
    """df with the attributes of its company (small dimension: Spark broadcasts it by its size); a company that isn't known
    has those of the first one, by slug."""
    rest = [c for c in companies.columns if c != "slug"]
    first = companies.agg(F.min_by(F.struct(*rest), "slug").alias("first"))
    known = companies.select("slug", F.struct(*rest).alias("own"))
    out = df.join(known, "slug", "left").join(F.broadcast(first))  # one row
    return out.select(*df.columns, F.coalesce("own", "first").alias("x")).select(*df.columns, "x.*")
