"""Labels, periods and figures: cases by hand."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import pages as P
from tallyframe.functions import urls as U
from tallyframe.operators import checking


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


KEYS = {
    "Net profit for the year": "net profit", "Net profit": "net profit", "Revenues": "revenue", "Total revenues (D.2)": "revenue", "Income/(Loss) from JV (3)": "income from jv",
    "Share-based payment expenses": "share based payment expense", "Increase/decrease in allowances": "change in allowance", "Decrease / increase in allowance": "change in allowance",
    "Net cash flows from operating activities": "net cash from operating activity", "Net cash generated from operating activities": "net cash from operating activity", "Tax refunds2": "tax refund",
    "Gross loss": "gross loss", "Taxes": "tax", "owner's equity": "owner  equity", "—": "—", "  ÉÉ ": "éé", "Profit for the financial year": "profit", "": "",
}


def test_canon_key(spark):
    got = one(spark, *[L.canon_key(F.lit(k)) for k in KEYS])
    assert dict(zip(KEYS, got)) == KEYS
    assert one(spark, L.canon_key(F.lit(None).cast("string"))) == (None,)


def test_clean_label(spark):
    cases = {"Other receivables, (A.1), (C.2)": "Other receivables", "Tax1 on  income": "Tax on income", " Revenue (D.2) ": "Revenue", "x": "x", "A12b": "A12b"}
    assert dict(zip(cases, one(spark, *[L.clean_label(F.lit(k)) for k in cases]))) == cases
    assert dict(zip(cases, one(spark, *[L.clean_label(L.clean_label(F.lit(k))) for k in cases]))) == cases


@pytest.mark.parametrize("label,expense", [("Cost of sales", True), ("Income taxes", True), ("Income tax expense", False), ("Income tax", True), ("Profit before income tax", False), ("Other expenses", True), ("Costume", False), ("Gross cost", False), ("Revenue", False)])
def test_expense(spark, label, expense):
    assert one(spark, L.is_expense_label(F.lit(label)), L.fix_expense_sign(F.lit(label), F.lit(5.0))) == (expense, -5.0 if expense else 5.0)


def test_period_year(spark):
    assert one(spark, *[L.period_year(F.lit(p)) for p in ("2025-12-31", "12/31/2021", "2015 €", "2025³", "FY25", "18991")]) == (2025, 2021, 2015, 2025, None, None)


def test_format_value(spark):
    f = lambda v, unit, d, s: L.format_value(F.lit(v).cast("double"), F.lit(unit), F.lit(d), F.lit(s))
    assert one(spark, f(None, None, 0, "€"), f(-1234.5, None, None, "€"), f(1234.567, "currency", 2, "kr"), f(1e6, "shares", 0, "$"), f(0.125, None, 2, "$")) == ("—", "-€1,235", "kr 1,234.57", "1,000,000", "$0.13")


def test_filings(spark):
    urls = {
        "https://a.test/annual-report-2019.pdf": ("annual-report-2019.pdf", 2019, "Annual Report"), "https://a.test/NN-AR17_UK.pdf": ("NN-AR17_UK.pdf", None, "Annual Report"),
        "https://a.test/x/AR16.pdf?v=2020": ("AR16.pdf", 2016, "Annual Report"), "https://a.test/q3-2020.pdf": ("q3-2020.pdf", 2020, "Quarterly Statement"), "https://a.test/100%.pdf": ("https://a.test/100%.pdf", None, "Other"),
        "https://a.test/a+b%20c.pdf": ("a+b c.pdf", None, "Other"), "https://climate.test/results.pdf": ("results.pdf", None, "ESG / Sustainability"),
    }
    for u, want in urls.items():
        t = U.filing_title(F.lit(u))
        assert one(spark, t, U.filing_year(t), U.classify_filing(F.lit(u))) == want


def test_hosts(spark):
    c = F.lit("Rheinstahl Group AG")
    assert one(spark, U.is_official_host(F.lit("https://IR.rheinstahl.com/x"), c), U.is_official_host(F.lit("https://other.de/"), c), U.is_official_host(F.lit("no url"), c)) == (True, False, False)
    assert one(spark, U.on_allowed_host(F.lit("https://cdn.firm.test/x"), F.array(F.lit("firm"))), U.is_pdf_url(F.lit("x.PDF#p")), U.is_pdf_href(F.lit("x.pdf#p")), U.is_pdf_href(F.lit("x.PDF?p"))) == (True, True, False, True)


def test_resolve(spark):
    rows = [("/a b.pdf", "https://X.test/y/"), ("c.pdf", "https://x.test/y/z"), ("mailto:a@b", "https://x.test"), (None, "https://x.test"), ("https://x.test:443", "https://y.test")]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, b string").select(U.resolve_url(F.col("h"), F.col("b"))).collect()]
    assert got == ["https://x.test/a%20b.pdf", "https://x.test/y/c.pdf", "mailto:a@b", None, "https://x.test/"]


#: One literal case for each rule of each list, so that a mistyped value shows even where SQL is made from the same list.
FILINGS = {
    "Registration Document": ["universal-registration.pdf", "registration_document.pdf", "x-urd-2020.pdf", "document-enregistrement.pdf", "ra-rf.pdf"],
    "Integrated Report": ["integrated-report.pdf"],
    "ESG / Sustainability": ["sustainability.pdf", "esg.pdf", "human-rights.pdf", "responsibility.pdf", "climate.pdf", "environment.pdf", "csrd.pdf", "tcfd.pdf", "non-financial.pdf"],
    "Earnings Presentation": ["presentation.pdf", "investor-deck.pdf", "slides.pdf"],
    "Half-Year Report": ["half-year.pdf", "halfyear.pdf", "interim.pdf", "semestriel.pdf", "first-half.pdf", "firsthalf.pdf", "h1.pdf", "1h20.pdf", "9m.pdf"],
    "Quarterly Statement": ["quarter.pdf", "q3.pdf", "q420.pdf"],
    "Financial Statements": ["financial-statements.pdf", "financial_statement.pdf", "financial-documents.pdf", "financialdocuments.pdf", "documents-financiers.pdf", "document-financier.pdf"],
    "Annual Report": ["annual-report.pdf", "annualreport.pdf", "annual_report.pdf", "form-20-f.pdf", "20f.pdf", "nn-ar.pdf", "ar16.pdf"],
    "Press Release": ["press.pdf", "release.pdf", "news.pdf", "announcement.pdf", "earnings.pdf", "results.pdf"],
    "Other": ["q5.pdf", "ar1.pdf", "purdy.pdf", "h12.pdf", "deck.pdf", "financials.pdf"],
}
REWRITTEN = {
    "Sales (a.1)": "sale", "Sales (12)": "sale", "Result (loss)": "result", "Result (profit) (gain)": "result", "Tax (income) (expense) (net)": "tax", "A - b/c": "a b c",
    "Increase decrease in x": "change in x", "Decrease/increase in x": "change in x", "Total12": "total", "Cash generated from x": "cash from x", "Cash generated by x": "cash from x",
    "Cash provided by x": "cash from x", "Cash used in x": "cash from x", "Cash used for x": "cash from x", "Cash flow from x": "cash from x", "Cash flows from x": "cash from x",
    "Profit for the year": "profit", "Profit for the financial period": "profit", "Total revenues": "revenue", "Companies": "company", "Boxes": "box", "Loss": "loss", "Incomes": "income",
}


def test_every_rule_of_filings(spark):
    cases = [(f"https://f.test/{n}", kind) for kind, names in FILINGS.items() for n in names]
    got = spark.createDataFrame(cases, "u string, kind string").select("u", "kind", U.classify_filing(F.col("u")).alias("got")).collect()
    assert [(r.u, r.got) for r in got] == [(r.u, r.kind) for r in got] and len(FILINGS) == len(U.FILING_RULES) + 1


def test_every_rewriting_of_labels(spark):
    got = spark.createDataFrame([(k,) for k in REWRITTEN], "x string").select("x", L.canon_key(F.col("x")).alias("k")).collect()
    assert {r.x: r.k for r in got} == REWRITTEN


def test_every_phrase_of_pages(spark):
    """Page by page: the score of each kind, whether it is disqualified, a landmark, a signature."""
    titles = {"income": ["income statement", "statement of operations", "statement of profit or loss", "profit and loss"], "balance": ["statement of financial position", "balance sheet"], "cashflow": ["statement of cash flows", "cash flow statement", "statements of cash flows"]}
    items = {
        "income": ["net sales", "total revenue", "gross profit", "operating profit", "operating income", "profit before tax", "profit after tax", "net income", "cost of sales", "cost of revenue"],
        "balance": ["total assets", "total equity", "total liabilities", "total current assets", "total non-current assets"], "cashflow": ["operating activities", "investing activities", "financing activities", "net cash"],
    }
    cases = [(h, k, 5) for k, hs in titles.items() for h in hs] + [(f"{a}: 1,234", k, 1) for k, xs in items.items() for a in xs] + [(f"{a}: none", k, 0) for k, xs in items.items() for a in xs]
    df = spark.createDataFrame(cases, "t string, kind string, want int")
    score = F.coalesce(*[F.when(F.col("kind") == k, P.page_score(F.col("t"), k)) for k in P.KINDS])
    assert [(r.t, r.got) for r in df.select("t", score.alias("got")).collect()] == [(t, n) for t, _, n in cases]
    bad = [f"{x} financial statements" for x in ("separate", "parent company", "company", "stand-alone", "standalone", "individual", "unconsolidated")] + ["significant accounting policies"]
    marks = ["consolidated income statement", "consolidated statement of", "income statement", "balance sheet", "statement of financial position", "statement of cash flows", "cash flow statement", "statement of comprehensive income", "statement of changes in equity", "notes to the consolidated", "notes to the financial", "independent auditor", "statutory auditor"]
    shown = spark.createDataFrame([(x,) for x in [*bad, *marks, "income", "auditor"]], "t string").select("t", P.disqualified(F.col("t")).alias("bad"), P.heading_of(F.col("t")).alias("head")).collect()
    assert {r.t for r in shown if r.bad} == set(bad) and {r.t for r in shown if r.head} == set(marks)
    ends = ["cash and cash equivalents at the end", "cash and cash equivalents at end", "at the end of the period", "at the end of the year", "at end of"]
    flows = "operating activities investing activities financing activities "
    sheets = ["total equity and liabilities", "total liabilities and equity", "total liabilities and shareholders", "total equity x total liabilities"]
    signed = spark.createDataFrame([(x,) for x in [*[flows + e for e in ends], flows, *[f"total assets {s}" for s in sheets], "total assets total equity", *sheets]], "t string")
    got = signed.select("t", P.has_cashflow_signature(F.col("t")).alias("c"), P.has_balance_signature(F.col("t")).alias("b")).collect()
    assert {r.t for r in got if r.c} == {flows + e for e in ends} and {r.t for r in got if r.b} == {f"total assets {s}" for s in sheets}


def test_every_name_of_checked_figures(spark):
    profits = ["net profit", "net income", "profit for the year", "profit for the period", "profit after tax", "profit after taxes", "earnings after taxes", "consolidated net income"]
    cells = [(f"p{i}", "income", 0, x, 1.0) for i, x in enumerate(profits)] + [(f"r{i}", "income", 0, x, 2.0) for i, x in enumerate(["revenue", "net sales", "turnover", "total operating performance"])]
    cells += [(f"b{i}", "balance", 0, x, 3.0) for i, x in enumerate(["total equity and liabilities", "total liabilities and equity"])] + [(f"c{i}", "balance", 0, x, 4.0) for i, x in enumerate(["cash and cash equivalents", "cash at bank and in hand", "cash"])]
    cells += [("o", "cashflow", 0, "net cash from operating activities", 5.0), ("e", "cashflow", 0, "cash at the end of the year", 6.0), ("t", "balance", 0, "Total assets ", 7.0)]
    df = spark.createDataFrame([(*c, 2020) for c in cells], "slug string, kind string, ord int, label string, value double, period_year int")
    got = {r.slug: r.asDict() for r in checking.headline_values(df).collect()}
    names = {"p": "profit", "r": "revenue", "b": "both", "c": "cash", "o": "operating", "e": "ending_cash", "t": "assets"}
    assert all(got[slug][names[slug[0]]] == v for slug, _, _, _, v in cells) and len(got) == len(cells)
    assert sorted(checking.CHECKS.values()) == sorted(["balance sheet balances (assets = equity + liabilities)", "net profit matches (income vs cash flow)", "ending cash matches (cash flow vs balance sheet)", "income: no revenue/sales value (wrong page?)", "balance: no total assets value (wrong page?)", "cashflow: no operating-activities value (wrong page?)"])
