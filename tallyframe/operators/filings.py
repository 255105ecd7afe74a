"""Links of investor pages and the catalogue of filings.

html_pages: slug, page_ord, url, html. companies: slug, name, hosts array<string>. discovered: slug, year, url.
filings: slug, year, type, title, url, used, ord (place of first sight within the company).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import urls as U

ANCHOR = r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


def extract_links(html_pages: DataFrame, cap: int | None = 200, keep_empty: bool = False) -> DataFrame:
    """Links of each page: its columns but html, then ord, text (100 characters), href (absolute). The first of each href
    on a page counts; links without text stay only if they name a PDF (or with keep_empty), and of those the first cap."""
    rest = [c for c in html_pages.columns if c != "html"]
    a = html_pages.select(*rest, F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("ord", "a"))
    a = a.select(*rest, "ord", F.regexp_extract("a", ANCHOR, 1).alias("raw"), F.substring(U.strip_tags(F.regexp_extract("a", ANCHOR, 2)), 1, 100).alias("text"))
    # links meet by page once; there each raw link is resolved once, and each address kept once
    first = F.min(F.struct("ord", "text")).alias("x")
    a = a.repartition(*rest).groupBy(*rest, "raw").agg(first).withColumn("href", U.resolve_url(F.col("raw"), F.col("url"))).where("href is not null")
    a = a.select(*rest, "x.*", "href").groupBy(*rest, "href").agg(first).select(*rest, "x.ord", "x.text", "href")
    if not keep_empty:
        a = a.where((F.col("text") != "") | F.lower("href").contains(".pdf"))
    if cap is not None:
        a = a.withColumn("n", F.row_number().over(Window.partitionBy(*rest).orderBy("ord"))).where(F.col("n") <= cap).drop("n")
    return a


def pdf_links(links: DataFrame) -> DataFrame:
    return links.where(U.is_pdf_href(F.col("href")))


def official_pdf_filter(links: DataFrame, companies: DataFrame) -> DataFrame:
    """PDF links on a company's own host, or listed on a page of it. links: slug, url, href."""
    c = companies.select("slug", F.col("name").alias("company"))
    own = U.is_official_host(F.col("href"), F.col("company")) | U.is_official_host(F.col("url"), F.col("company"))
    return pdf_links(links).join(c, "slug").where(own).drop("company")


def search_results(html_pages: DataFrame, most: int = 8) -> DataFrame:
    rest = [c for c in html_pages.columns if c != "html"]
    return html_pages.select(*rest, F.posexplode(U.search_results(F.col("html"), most)).alias("ord", "x")).select(*rest, "ord", "x.title", "x.url")


def _labelled(df: DataFrame) -> DataFrame:
    url = F.col("url")
    return df.withColumn("title", U.filing_title(url)).withColumn("type", U.classify_filing(url))


def catalog_filings(links: DataFrame, companies: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """The filings that a company's pages link to: PDFs on allowed hosts, each URL once, at its first sight by page and
    link order; then those of the discovered map that weren't seen (with its year where the title has none), as used.
    links: slug, page_ord, ord, href."""
    url = F.col("url")
    seen = links.select("slug", F.col("href").alias("url"), F.struct("page_ord", "ord").alias("at")).where(U.is_pdf_url(url))
    seen = seen.join(companies.select("slug", "hosts"), "slug").where(U.on_allowed_host(url, F.col("hosts")))
    seen = seen.groupBy("slug", "url").agg(F.min("at").alias("at"))
    out = _labelled(seen).select("slug", U.filing_year(F.col("title")).alias("year"), "type", "title", "url", F.lit(False).alias("used"), F.struct(F.lit(0).alias("part"), F.col("at.page_ord").cast("long").alias("page_ord"), F.col("at.ord").cast("long").alias("ord"), F.lit("").alias("u")).alias("at"))
    if discovered is not None:
        more = discovered.groupBy("slug", "url").agg(F.min("year").alias("key_year")).join(seen, ["slug", "url"], "left_anti").join(companies.select("slug"), "slug", "left_semi")
        year = F.coalesce(U.filing_year(F.col("title")), F.nullif("key_year", F.lit(0)))
        at = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("page_ord"), F.lit(0).cast("long").alias("ord"), F.col("url").alias("u"))
        out = out.unionByName(_labelled(more).select("slug", year.alias("year"), "type", "title", "url", F.lit(True).alias("used"), at.alias("at")))
    order = Window.partitionBy("slug").orderBy(F.desc(F.coalesce("year", F.lit(0))), F.lower("type"), "at")
    return out.withColumn("ord", F.row_number().over(order) - 1).drop("at")


def filter_filings(filings: DataFrame, type_: str = "All") -> DataFrame:
    return (filings if type_ == "All" else filings.where(F.col("type") == type_)).orderBy("slug", "ord")


def pick_report_url(filings: DataFrame) -> DataFrame:
    """For each company and year the first annual report, else the first financial statements: slug, year, url."""
    place = F.when(F.col("type") == "Annual Report", 0).when(F.col("type") == "Financial Statements", 1)
    f = filings.where("year is not null and year <> 0").withColumn("place", place).where("place is not null")
    return f.groupBy("slug", "year").agg(F.min_by("url", F.struct("place", "ord")).alias("url"))


def fill_discovered(filings: DataFrame, discovered: DataFrame) -> DataFrame:
    """discovered, and a picked URL for each company and year that it lacks (or has as an empty string)."""
    known = discovered.where("url is not null and url <> ''").select("slug", "year", "url")
    return known.unionByName(pick_report_url(filings).join(known, ["slug", "year"], "left_anti"))


def mark_used(filings: DataFrame, discovered: DataFrame) -> DataFrame:
    d = discovered.select("slug", "url").distinct().withColumn("found", F.lit(True))
    f = filings.join(d, ["slug", "url"], "left")
    return f.withColumn("used", F.coalesce("used", F.lit(False)) | F.coalesce("found", F.lit(False))).drop("found").select(*filings.columns)


def filings_by_type(filings: DataFrame) -> DataFrame:
    """slug, type ("All" for a company's total), n, n_used; types by falling count within a company."""
    r = filings.rollup("slug", "type").agg(F.count("*").alias("n"), F.sum(F.col("used").cast("int")).alias("n_used"), F.grouping("type").alias("total"), F.grouping("slug").alias("g"))
    return r.where("g = 0").select("slug", F.when(F.col("total") == 1, "All").otherwise(F.col("type")).alias("type"), "n", "n_used").orderBy("slug", F.desc("n"), "type")


def merge_catalog(old: DataFrame, new: DataFrame, scraped: DataFrame) -> DataFrame:
    """new filings of the scraped companies (slug), old ones of all others."""
    s = scraped.select("slug").distinct()
    return old.join(s, "slug", "left_anti").unionByName(new.join(s, "slug", "left_semi"), allowMissingColumns=True)
