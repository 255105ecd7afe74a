"""Inputs of the financial operators, derived from the given tables by SQL that Spark and DuckDB both run.

Each customer is a company (slug), each year of its orders a fiscal year. A report of year y states y and the two years
before, under labels whose wording changes from report to report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: slug, y, item, amt: what a company's orders of a year came to, by type of part.
FACTS = """
SELECT concat('c', CAST(c_custkey AS STRING)) AS slug, CAST(year(o_orderdate) AS INT) AS y, p_type AS item, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
GROUP BY 1, 2, 3
"""

#: Long rows of the reports: slug, report_year, kind, rank (order in the statement), label, row_kind, period_year, value.
CELLS = """
WITH f AS (SELECT slug, y, item, CAST(amt AS DOUBLE) AS a FROM {facts}),
t AS (SELECT slug, y, CAST(sum(amt) AS DOUBLE) AS s FROM {facts} GROUP BY slug, y),
k AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2),
income AS (
  SELECT slug, y + k AS report_year, 'income' AS kind, item AS rank,
    concat(item, CASE (y + k) % 4 WHEN 0 THEN ' costs' WHEN 1 THEN ' cost (D.2)' WHEN 2 THEN ' Costs1' ELSE ' cost for the year' END) AS label, 'line' AS row_kind, y AS period_year,
    (CASE WHEN length(item) % 3 = 0 THEN a + k * 100 ELSE a END) * (CASE WHEN (y + k) % 2 = 0 THEN -1 ELSE 1 END) AS value
  FROM f CROSS JOIN k WHERE NOT (y + k = 2000 AND length(item) % 2 = 0)
),
sheet AS (
  SELECT 'income' AS kind, '0' AS rank, 'Revenues' AS label, 'line' AS row_kind, 1.0 AS part, 0 AS wrong UNION ALL
  SELECT 'income', 'z1', 'Cost of sales', 'subtotal', -0.6, 0 UNION ALL
  SELECT 'income', 'z2', 'Net profit', 'total', 0.1, 0 UNION ALL
  SELECT 'income', 'z3', 'Other income', 'line', 0.01, 0 UNION ALL
  SELECT 'income', 'z4', 'Other incomes (2)', 'line', 0.02, 0 UNION ALL
  SELECT 'balance', '0', 'Assets', 'section', NULL, 0 UNION ALL
  SELECT 'balance', '1', 'Inventories1', 'line', 0.5, 0 UNION ALL
  SELECT 'balance', '2', 'Other receivables', 'line', 0.25, 0 UNION ALL
  SELECT 'balance', '3', 'Cash and cash equivalents (B.1)', 'line', 0.125, 0 UNION ALL
  SELECT 'balance', '4', 'Total current assets', 'subtotal', 0.875, 0 UNION ALL
  SELECT 'balance', '5', 'Other receivables (3)', 'line', 0.125, 0 UNION ALL
  SELECT 'balance', '6', 'Total assets', 'total', 1.0, 0 UNION ALL
  SELECT 'balance', '7', 'Borrowings', 'line', 0.25, 0 UNION ALL
  SELECT 'balance', '8', 'Total current liabilities', 'subtotal', 0.25, 0 UNION ALL
  SELECT 'balance', '9', 'Borrowings', 'line', 0.75, 0 UNION ALL
  SELECT 'balance', 'a', 'Total equity and liabilities', 'total', 1.0, 5 UNION ALL
  SELECT 'cashflow', '0', 'Operating activities', 'section', NULL, 0 UNION ALL
  SELECT 'cashflow', '1', 'Net profit', 'line', 0.1, 4 UNION ALL
  SELECT 'cashflow', '2', 'Net cash flows from operating activities', 'total', 0.1, 0 UNION ALL
  SELECT 'cashflow', '3', 'Cash at the end of the year', 'total', 0.125, 3
),
fixed AS (
  SELECT slug, y + k AS report_year, kind, rank, label, row_kind, y AS period_year,
    CAST(s * part * CASE WHEN wrong > 0 AND y % (CASE WHEN wrong > 0 THEN wrong ELSE 1 END) = 0 THEN 1.25 ELSE 1.0 END AS DOUBLE) AS value
  FROM t CROSS JOIN k CROSS JOIN sheet WHERE NOT (label = 'Total assets' AND y = 1997)
)
SELECT * FROM income UNION ALL SELECT * FROM fixed
"""

#: Pages of reports: each source is a company, its documents the pages, some with what statements say.
PAGES = """
SELECT source AS slug, CAST(2000 + n // 60 AS INT) AS report_year, CAST(n % 60 AS INT) AS page_index,
  concat('Annual report | ', source, chr(10), CASE WHEN doc_id % 7 = 0 THEN concat('Consolidated statement of financial position Total assets 12345 total equity and liabilities ', CAST(doc_id AS STRING))
    WHEN doc_id % 7 = 1 THEN 'Consolidated income statement Revenue net sales 1234 gross profit 567 operating profit 89' WHEN doc_id % 7 = 2 THEN 'Consolidated statement of cash flows operating activities 12 investing activities 34 financing activities 56 cash and cash equivalents at the end 78'
    WHEN doc_id % 7 = 3 THEN 'significant accounting policies total assets 55 balance sheet' ELSE '' END, chr(10), text) AS text
FROM {numbered} AS d
"""
#: The same numbers in one step, for an engine on one machine.
NUMBERED = "(SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM {documents})"
#: Documents of a source that are numbered together.
RANGE = 4096

#: Links of filings: slug (of the page's host), page_ord, ord, href.
FILING_LINKS = """
SELECT host AS slug, CAST(page_id AS BIGINT) AS page_ord, 0 AS ord, concat('https://www.', host, '/', CASE page_id % 12
  WHEN 0 THEN 'annual-report-2019.pdf' WHEN 1 THEN 'NN-AR17_UK.pdf' WHEN 2 THEN 'q3-2020-statement.pdf?x=1' WHEN 3 THEN 'Annual%20Report%20AR16.pdf' WHEN 4 THEN 'esg_climate+2021.PDF'
  WHEN 5 THEN '100%.pdf' WHEN 6 THEN 'results/press-2018.pdf#page=2' WHEN 7 THEN concat('universal-registration-', CAST(2000 + page_id % 25 AS STRING), '.pdf') WHEN 8 THEN 'half-year/h1.pdf'
  WHEN 9 THEN 'financial-statements-2019.pdf' WHEN 10 THEN 'investor-deck.html' ELSE concat('doc', CAST(page_id AS STRING), '-2012.pdf') END) AS href
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host FROM {pages}) AS p WHERE host <> ''
"""


def _sql(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    names = [n for n in ("lineitem", "orders", "customer", "part", "documents", "pages") if "{%s}" % n in sql]
    return spark.sql(sql.replace(" // ", " DIV "), **given, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FACTS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CELLS, facts=facts(spark, sf_dir))


#: What each statement states beside its items, as in CELLS: rank, label, row_kind, part of the year's total, every how
#: many years it is wrong.
SHEET = {
    "income": [("0", "Revenues", "line", 1.0, 0), ("z1", "Cost of sales", "subtotal", -0.6, 0), ("z2", "Net profit", "total", 0.1, 0), ("z3", "Other income", "line", 0.01, 0), ("z4", "Other incomes (2)", "line", 0.02, 0)],
    "balance": [
        ("0", "Assets", "section", None, 0), ("1", "Inventories1", "line", 0.5, 0), ("2", "Other receivables", "line", 0.25, 0), ("3", "Cash and cash equivalents (B.1)", "line", 0.125, 0),
        ("4", "Total current assets", "subtotal", 0.875, 0), ("5", "Other receivables (3)", "line", 0.125, 0), ("6", "Total assets", "total", 1.0, 0), ("7", "Borrowings", "line", 0.25, 0),
        ("8", "Total current liabilities", "subtotal", 0.25, 0), ("9", "Borrowings", "line", 0.75, 0), ("a", "Total equity and liabilities", "total", 1.0, 5),
    ],
    "cashflow": [("0", "Operating activities", "section", None, 0), ("1", "Net profit", "line", 0.1, 4), ("2", "Net cash flows from operating activities", "total", 0.1, 0), ("3", "Cash at the end of the year", "total", 0.125, 3)],
}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, y, item, amt of FACTS before they are summed, a company's in one partition."""
    t = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    x = t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice").join(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    slug, amount = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("l_extendedprice").cast("decimal(18,2)")
    return x.select(slug.alias("slug"), F.year("o_orderdate").alias("y"), F.col("p_type").alias("item"), amount.alias("amt")).repartition("slug")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as reports: rows in order of rank, a period for each year that the report states, newest first.

    The same as as_reports of the cells, without making them: only items are ever rows of their own, the sheet is dealt
    to a report when it is put together. One shuffle after the joins, by company.
    """
    ks, year = range(3), F.col("report_year")
    f = lines(spark, sf_dir).groupBy("slug", "y", "item").agg(F.sum("amt").alias("amt"))
    f = f.select("slug", "y", "item", "amt", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).select("slug", (F.col("y") + F.col("k")).alias("report_year"), "item", "amt", F.when(F.col("y").isNotNull(), F.col("k")).alias("k"))
    # an item's figures in a report, one for each year before it
    f = f.groupBy("slug", "report_year", "item").agg(*[F.max(F.when(F.col("k") == k, F.col("amt"))).alias(f"a{k}") for k in ks], *[F.max(F.col("k") == k).alias(f"has{k}") for k in ks])
    a = lambda k: F.col(f"a{k}").cast("double")
    figure = lambda k: F.when(F.length("item") % 3 == 0, a(k) + F.lit(k * 100)).otherwise(a(k)) * F.when(year % 2 == 0, -1).otherwise(1)
    label = F.concat("item", F.when(year % 4 == 0, " costs").when(year % 4 == 1, " cost (D.2)").when(year % 4 == 2, " Costs1").otherwise(" cost for the year"))
    one = F.when(~((year == 2000) & (F.length("item") % 2 == 0)), F.struct(F.col("item").alias("rank"), label.alias("label"), F.lit("line").alias("row_kind"), F.array(*[figure(k) for k in ks]).alias("values")))
    r = f.groupBy("slug", "report_year").agg(F.collect_list(one).alias("items"), *[F.sum(f"a{k}").cast("double").alias(f"s{k}") for k in ks], *[F.max(f"has{k}").alias(f"has{k}") for k in ks])
    # a report's years are told by plain expressions over its three, not by functions of an array: those aren't compiled
    has = lambda k: F.coalesce(F.col(f"has{k}"), F.lit(False))
    stating = lambda of, one: F.concat(*[F.when(has(k), F.array(one(k).cast(of))).otherwise(F.array().cast(f"array<{of}>")) for k in ks])
    some = has(ks[0]) & (year != 1997)  # whether it states any year but 1997
    for k in ks[1:]:
        some = some | (has(k) & (year - k != 1997))

    def stated(label: str, part: float | None, wrong: int) -> Column:
        """The figures of a row of the sheet, one for each year stated."""
        if part is None:
            return stating("double", lambda k: F.lit(None))
        times = lambda k: F.col(f"s{k}") * F.lit(part) * F.when((year - k) % wrong == 0, 1.25).otherwise(1.0) if wrong else F.col(f"s{k}") * F.lit(part)
        return stating("double", (lambda k: F.when(year - k != 1997, times(k))) if label == "Total assets" else times)

    row = lambda label, kind, values: F.struct(label.alias("label"), kind.alias("kind"), F.lit("currency").alias("unit"), F.lit(0).alias("decimals"), values.alias("values"))

    def statement(kind: str) -> Column:
        rows = [(rank, label, row(F.lit(label), F.lit(what), stated(label, part, wrong))) for rank, label, what, part, wrong in SHEET[kind]]
        if kind != "income":
            # this row is left out where a report states nothing but the year that lacks it
            return F.concat(*[F.when(some, F.array(x)).otherwise(F.slice(F.array(x), 1, 0)) if label == "Total assets" else F.array(x) for _, label, x in rows])
        ranked = lambda rank, x: F.struct(rank.alias("rank"), x.alias("row"))
        own = lambda x: stating("double", lambda k: F.get(x["values"], F.lit(k)))
        full = has(ks[0]) & has(ks[1]) & has(ks[2])
        items = F.transform("items", lambda x: ranked(x["rank"], row(x["label"], x["row_kind"], F.when(full, x["values"]).otherwise(own(x)))))
        return F.sort_array(F.concat(items, F.array(*[ranked(F.lit(rank), x) for rank, _, x in rows])))["row"]

    r = r.select("slug", "report_year", stating("string", lambda k: F.concat(F.lit("12/31/"), (year - k).cast("string"))).alias("periods"), *[statement(kind).alias(kind) for kind in SHEET])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("rows")) for kind in SHEET])
    return r.select("slug", "report_year", "periods", F.inline(kinds)).select("slug", "report_year", "kind", "periods", "rows")


def as_reports(cells: DataFrame, ks: range) -> DataFrame:
    """Long rows as reports that state their own year and those before it, as far as ks goes."""
    c = cells.withColumn("k", F.col("report_year") - F.col("period_year")).repartition("slug", "report_year", "kind")
    row = c.groupBy("slug", "report_year", "kind", "rank", "label", "row_kind").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in ks], *[F.max(F.col("k") == k).alias(f"has{k}") for k in ks])
    one = F.struct("rank", "label", "row_kind", F.array(*[f"v{k}" for k in ks]).alias("values"))
    r = row.groupBy("slug", "report_year", "kind").agg(F.array_sort(F.collect_list(one)).alias("all"), *[F.max(f"has{k}").alias(f"has{k}") for k in ks])
    r = r.withColumn("ks", F.array_compact(F.array(*[F.when(F.col(f"has{k}"), F.lit(k)) for k in ks])))
    periods = F.transform("ks", lambda k: F.concat(F.lit("12/31/"), (F.col("report_year") - k).cast("string")))
    values = lambda x: F.transform("ks", lambda k: F.get(x["values"], k))
    rows = F.transform("all", lambda x: F.struct(x["label"].alias("label"), x["row_kind"].alias("kind"), F.lit("currency").alias("unit"), F.lit(0).alias("decimals"), values(x).alias("values")))
    return r.select("slug", "report_year", "kind", periods.alias("periods"), rows.alias("rows"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with n, each source's documents counted from 0 by doc_id: ranges of ids get their first number from the counts
    before them, so a source of very many documents is numbered in many tasks."""
    d = docs.select("source", "doc_id", "text", F.floor(F.col("doc_id") / RANGE).alias("range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("source", "range").agg(F.count("*").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("doc_id")
    return d.withColumn("row", F.row_number().over(inside)).join(starts, ["source", "range"]).select("source", "doc_id", "text", (F.col("start") + F.col("row") - 1).alias("n"))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PAGES, numbered=numbered(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def rowless(reports: DataFrame) -> DataFrame:
    """reports where some companies' cash-flow statements have periods but no rows."""
    gone = (F.col("kind") == "cashflow") & F.col("slug").like("%7")
    return reports.withColumn("rows", F.when(gone, F.array().cast(reports.schema["rows"].dataType)).otherwise(F.col("rows")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as a model's replies: JSON between words or in a code fence; some are cut off and so no JSON."""
    r = reports(spark, sf_dir)
    json = F.to_json(F.struct("periods", "rows"))
    told = F.when(F.col("report_year") % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(F.col("report_year") % 3 == 1, F.concat(F.lit("Here: "), json, F.lit(" Done."))).otherwise(json)
    return r.select("slug", "report_year", "kind", F.when(F.col("slug").like("%3") & (F.col("kind") == "balance"), F.lit('{"periods":["2020"')).otherwise(told).alias("reply"))


#: A page of filings as investor pages have them, in links: relative ones, repeated ones, PDFs without text, and on some
#: pages more than two hundred. n: link's number, href and text: what it says.
SHELF = """
SELECT page_id, host, n, CASE WHEN n % 4 = 0 THEN concat('/docs/annual-report-', CAST(2000 + n // 4 % 25 AS STRING), '.pdf') WHEN n % 4 = 1 THEN concat('https://', host, '/docs/annual-report-', CAST(2000 + n // 8 % 25 AS STRING), '.pdf')
    WHEN n % 4 = 2 THEN concat('/ir/q', CAST(1 + n % 3 AS STRING), '-', CAST(2010 + n % 10 AS STRING), '.pdf?v=', CAST(n AS STRING)) ELSE concat('/news/', CAST(n AS STRING)) END AS href,
  CASE WHEN n % 4 = 2 THEN '' WHEN n % 12 = 3 THEN ' ' ELSE concat('Link <b>', CAST(n AS STRING), '</b>') END AS text
FROM {hosts} CROSS JOIN {numbers} WHERE n < CASE WHEN page_id % 10 = 0 THEN 280 ELSE 12 END
"""
HOSTS = "(SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') AS host FROM {pages})"


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as HTML: slug (the host), page_ord, url, html."""
    hosts = _sql(spark, sf_dir, f"SELECT * FROM {HOSTS} AS h WHERE host <> ''")
    most = F.when(F.col("page_id") % 10 == 0, 279).otherwise(11)
    links = _sql(spark, sf_dir, SHELF.replace("{hosts} CROSS JOIN {numbers}", "{numbered}"), numbered=hosts.withColumn("n", F.explode(F.sequence(F.lit(0), most))))
    one = F.concat(F.lit('<a class="x" href="'), "href", F.lit('">'), "text", F.lit("</a>"))
    p = links.groupBy("page_id", "host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("a")))), lambda x: x["a"]), "\n").alias("body"))
    return p.select(F.col("host").alias("slug"), F.col("page_id").alias("page_ord"), F.concat(F.lit("https://"), "host", F.lit("/ir/index.html")).alias("url"), F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("html"))


def filing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FILING_LINKS)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", "html")
