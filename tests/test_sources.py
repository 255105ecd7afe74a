"""Readers, writers, small filters, and faults found in use."""

import glob
import json
import os
import random
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from tallyframe import sources, streaming
from tallyframe.functions import labels as L
from tallyframe.functions import urls as U
from tallyframe.operators import checking, compiling, filings
from tests.test_operators import SCHEMA, by, reports, row


def test_discovered_and_catalog_files(spark, tmp_path):
    (tmp_path / "found.json").write_text(json.dumps({"firm:2020": "https://a.test/x.pdf", "firm:20x": "https://a.test/y.pdf", "other": "u"}))
    assert by(sources.read_discovered(spark, f"{tmp_path}/found.json"), "slug", "year", "url") == sorted([("firm", 2020, "https://a.test/x.pdf"), ("firm", None, "https://a.test/y.pdf"), ("other", None, "u")], key=str)
    kind = "slug string, year int, type string, title string, url string, used boolean, ord int"
    first = spark.createDataFrame([("a", 2020, "Annual Report", "t", "u1", True, 0), ("b", 2020, "Other", "t", "u2", False, 0)], kind)
    sources.write_catalog(first, f"{tmp_path}/catalog")
    sources.write_catalog(first.where("slug = 'a'").withColumn("url", F.lit("new")), f"{tmp_path}/catalog")
    assert by(sources.read_filings(spark, f"{tmp_path}/catalog"), "slug", "url") == [("a", "new"), ("b", "u2")]


def test_filters(spark):
    f = spark.createDataFrame([("a", "Other", 1), ("a", "Annual Report", 0), ("b", "Other", 0)], "slug string, type string, ord int")
    assert [(r.slug, r.ord) for r in filings.filter_filings(f).collect()] == [("a", 0), ("a", 1), ("b", 0)]
    assert by(filings.filter_filings(f, "Other"), "slug", "ord") == [("a", 1), ("b", 0)]
    assert by(sources.filter_companies(f, "b"), "type") == [("Other",)] and sources.filter_companies(f).count() == 3
    with pytest.raises(ValueError, match="unknown company"):
        sources.filter_companies(f, "c")
    for bad in ("2015", "15-25", "2015-20x5", "2015–2025"):
        with pytest.raises(ValueError, match="2015-2025"):
            sources.filter_years(f, bad, "ord")
    assert sources.filter_years(f, None).count() == 3


def test_company_lookup_falls_back_to_the_first(spark):
    c = spark.createDataFrame([("b", "EUR"), ("a", "USD")], "slug string, currency string")
    rows = spark.createDataFrame([("b", 1), ("x", 2), (None, 3)], "slug string, v int")
    assert by(sources.company_lookup(rows, c), "v", "currency") == [(1, "EUR"), (2, "USD"), (3, "USD")]
    assert by(sources.company_lookup(rows, c.limit(0)), "v", "currency") == [(1, None), (2, None), (3, None)]


def test_display_order(spark):
    w = spark.createDataFrame([("a", "income", True, 0), ("a", "income", False, 2), ("a", "income", False, 1), ("a", "income", True, 3)], "slug string, kind string, historical boolean, ord int")
    assert [r.ord for r in compiling.display_order(w).collect()] == [1, 2, 0, 3]


def test_format_of_any_decimals(spark):
    df = spark.createDataFrame([(1234.5, d) for d in (None, 0, 2, 6, 7, 9, -1)], "v double, d int")
    shown = [r.s for r in df.select(L.format_value(F.col("v"), F.lit("currency"), F.col("d"), F.lit("€")).alias("s")).collect()]
    assert shown == ["€1,235", "€1,235", "€1,234.50", "€1,234.500000", "€1,234.5000000", "€1,234.500000000", "€1,235"]


def test_rows_of_unknown_kind_end_a_block(spark):
    c = spark.createDataFrame([("a", "income", i, label, kind, 2020, v) for i, (label, kind, v) in enumerate([("A", "line", 5.0), ("?", None, 1.0), ("Total", "total", 9.0)])], "slug string, kind string, ord int, label string, row_kind string, period_year int, value double")
    assert by(checking.reconcile(c), "label", "line_sum", "reported") == [("Total", 0.0, 9.0)]


def test_statement_without_rows_is_not_covered(spark):
    r = reports(spark, (2020, "income", ["2020"], [row("Revenue", "line", [1.0])]), (2020, "cashflow", ["2020", "2019"], []))
    issues = checking.validate(compiling.compile_statements(r, markers=True))
    assert by(issues, "check", "period_year") == [(checking.CHECKS["no_cashflow"], 2019), (checking.CHECKS["no_cashflow"], 2020)]


def test_repeats_and_rows_without_label(spark):
    r = reports(spark, (2020, "income", ["2020"], [row("Other", "line", [1.0]), row(None, "line", [9.0]), row("Others", "line", [2.0]), row("Other (3)", "line", [3.0])]))
    assert by(compiling.statement_rows(r), "pos", "key") == [(0, "other"), (2, "other#1"), (3, "other#2")]
    assert by(compiling.compile_statements(r), "key", "value") == sorted([("other", 1.0), ("other#1", 2.0), ("other#2", 3.0)], key=str)
    assert compiling.compile_statements(r.limit(0)).count() == 0


def test_round_trip_of_a_statement(spark):
    """A statement cut into reports of three years compiles to itself, and one changed older figure to one restated cell."""
    years, labels = list(range(2023, 2012, -1)), ["Revenue", "Cost of sales", "Other income", "Net profit"]
    value = {(x, y): (-1.0 if x == "Cost of sales" else 1.0) * (100 * i + y % 100) for i, x in enumerate(labels) for y in years}
    build = lambda change: reports(spark, *[(y, "income", [f"FY{p}" for p in range(y, y - 3, -1)], [row(x, "line", [value.get((x, p)) if (x, p, y) != change else 7.5 for p in range(y, y - 3, -1)]) for x in labels]) for y in years])
    c = compiling.compile_statements(build(None)).where("value is not null").collect()
    assert {(r.label, r.period_year): r.value for r in c} == value and not any(r.restated or r.historical for r in c)
    c = compiling.compile_statements(build(("Revenue", 2018, 2018))).where("value is not null").collect()
    assert [(r.label, r.period_year) for r in c if r.restated] == [("Revenue", 2018)] and {(r.label, r.period_year): r.value for r in c} == value


def absolute(href, base):
    """resolve_url in plain Python."""
    try:
        s = urlsplit(urljoin(base, re.sub(r"[\t\n\r]", "", href.strip())))
    except ValueError:
        return None
    if not s.scheme or (s.scheme in ("http", "https") and not s.netloc):
        return None
    if s.scheme not in ("http", "https"):
        return s.geturl()
    host = s.netloc.lower().removesuffix(":80" if s.scheme == "http" else ":443")
    safe = "!$%&'()*+,-./:;=@_~[]|^"
    return urlunsplit((s.scheme, host, quote(s.path or "/", safe=safe), quote(s.query, safe=safe + "?{}`\\"), quote(s.fragment, safe=safe + "?{}\\#")))


def resolved(spark, pairs):
    return [r.u for r in spark.createDataFrame(pairs, "h string, b string").select(U.resolve_url(F.col("h"), F.col("b")).alias("u")).collect()]


def test_links_equal_plain_python(spark):
    pairs = [(h, b) for b in ("https://a.test/x/y.html", "http://A.test:80/x", "https://a.test", "nothing", None) for h in ["/p.pdf", "p.pdf", "https://b.test/q?x=1#f", "https://b.test", "http://b.test:80/", "//c.test/z", "/a/../b", "/a b", "?q", "#f", "mailto:x@y", "https://b.test/a/./b", "/ü", "", None, "/p?", "/p#", "HTTP://B.test/x", "/x//y"]]
    got = resolved(spark, pairs)
    assert got == [absolute(h, b) if h is not None and b is not None else u for (h, b), u in zip(pairs, got)]
    assert all(u is None for (h, b), u in zip(pairs, got) if h is None or (b is None and not h.startswith("http")))


def test_made_up_links_equal_plain_python(spark):
    rng = random.Random(7)
    parts = ["a", "b.pdf", "..", ".", "", "é", "x y", "%20", "A|B", '"q"', "it's", "c:d", "{z}", "~u", "a;b=1", "[1]", "日本", "\U0001f600", "a\tb", "...", "..a"]
    hosts = ["a.test", "B.Test", "a.test:80", "a.test:443", "a.test:8080", "u:P@h.test", "ü.test", "[::1]", "[::1]:80"]
    path = lambda n: "/".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    tail = lambda: rng.choice(["", "", "?", "?x=1", "?q=é", "?a b", "?a?b", "?x/../y", "?`{"]) + rng.choice(["", "", "#", "#f", "#é", "#a b", "##x", "#`{", "#?y"])
    whole = lambda schemes: rng.choice(schemes) + "://" + rng.choice(hosts) + rng.choice(["", "/" + path(5)]) + tail()
    odd = ["mailto:x@y", "javascript:;", "tel:+1", "data:,x", "http:foo", "https:foo/../b", "https:", "  ", "\n/x ", "a:b", "1:b", "\xa0/p\xa0", "http://h[x/y", "//h]/y", "http://a／b.test/"]
    link = lambda: rng.choice([lambda: whole(["http", "https", "HTTP", "ftp", "app"]), lambda: "//" + rng.choice(hosts) + "/" + path(5) + tail(), lambda: "/" + path(6) + tail(), lambda: path(6) + tail(), lambda: rng.choice(odd)])()
    pairs = [(link(), whole(["http", "https", "HTTPS"]) if rng.random() < 0.95 else rng.choice(["nothing", "mailto:x", ""])) for _ in range(10000)]
    got = resolved(spark, pairs)
    assert [(p, u) for p, u in zip(pairs, got)] == [((h, b), absolute(h, b)) for h, b in pairs]
    assert len({u for u in got if u}) > 3000


def test_links_need_no_python_worker(spark):
    df = spark.createDataFrame([("f", "https://f.test/x", '<a href="../é.pdf">e</a>')], "slug string, url string, html string")
    links = filings.extract_links(df)
    assert by(links, "href") == [("https://f.test/%C3%A9.pdf",)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "pandas" not in plan.lower()


def test_link_of_a_page_counts_once(spark):
    html = '<a href="/a.pdf"></a><a href="/a.pdf">again</a><a href="https://f.test/a.pdf">whole</a><a href="/n"></a>' + "".join(f'<a href="/l{i}">l</a>' for i in range(250))
    df = spark.createDataFrame([("f", "https://f.test/x", html)], "slug string, url string, html string")
    links = filings.extract_links(df)
    assert links.count() == 200 and by(links.where("ord < 4"), "ord", "text", "href") == [(0, "", "https://f.test/a.pdf")]
    assert filings.extract_links(df, cap=None, keep_empty=True).count() == 252


def test_refresh_of_nothing(spark, tmp_path):
    (tmp_path / "new").mkdir()
    where = [f"{tmp_path}/{n}" for n in ("new", "reports", "compiled", "checkpoint")]
    streaming.refresh_incremental(spark, *where, buckets=2)
    spark.createDataFrame([("a", 2020, "income", ["2020"], [row("Revenue", "line", [1.0])])], SCHEMA).write.mode("append").parquet(where[0])
    streaming.refresh_incremental(spark, *where, buckets=2)
    assert by(sources.read_published(spark, where[2]), "slug", "value") == [("a", 1.0)]


GOLDEN = sorted(glob.glob(f"{os.environ.get('GOLDEN_STATEMENTS', '/nonexistent')}/*.ts"))


def golden(path):
    """The JSON values that a data module exports, by name."""
    text = open(path).read()
    out = {}
    for m in re.finditer(r"export const (\w+)[^=]*= ", text):
        try:
            out[m[1]] = json.JSONDecoder().raw_decode(text, m.end())[0]
        except ValueError:
            pass
    return out


def check_published(spark, paths):
    """Published statements validate as they were published, and filings have the titles, types and years they should."""
    checked = 0
    for path in paths:
        data = golden(path)
        if "filings" in data:
            rows = [(slug, f["url"], f["title"], f["type"], f["year"]) for slug, fs in data["filings"].items() for f in fs]
            df = spark.createDataFrame(rows, "slug string, url string, title string, type string, year int")
            u = F.col("url")
            off = df.where((U.filing_title(u) != F.col("title")) | (U.classify_filing(u) != F.col("type")))
            assert off.count() == 0
            # where a title bears no year, or one of another form, the year is that of the discovered map
            assert df.where(~U.filing_year(F.col("title")).eqNullSafe(F.col("year"))).count() <= 2
            checked += 1
        elif "validation" in data:
            kinds = {k: data[n] for n in data for k in ("income", "balance", "cashflow") if n.lower().startswith(k)}
            slug = os.path.basename(path)[:-3]
            cells = [(slug, k, i, r["label"], r["kind"], int(re.search("(?:19|20)[0-9]{2}", p)[0]), v) for k, s in kinds.items() for i, r in enumerate(s["rows"]) for p, v in zip(s["periods"], r.get("values") or [None] * len(s["periods"]))]
            c = spark.createDataFrame([(*x[:6], float(x[6]) if x[6] is not None else None) for x in cells], "slug string, kind string, ord int, label string, row_kind string, period_year int, value double")
            issues = checking.validate(c)
            status = checking.validation_status(issues, c).first()["status"]
            want = data["validation"]
            assert (status, issues.count()) == (want["status"], len(want["issues"])), path
            checked += 1
    return checked


#: A small company made up for the tests: its lines by year, newest first, as a published module has them.
YEARS = list(range(2023, 2014, -1))
FIRM = {
    "income": [("Revenue", "line", lambda y: 900.0 + 10 * (y - 2015)), ("Cost of sales", "line", lambda y: -500.0 - 5 * (y - 2015)), ("Gross profit", "subtotal", lambda y: 400.0 + 5 * (y - 2015)), ("Selling expenses", "line", lambda y: -150.0), ("Operating profit", "subtotal", lambda y: -150.0), ("Net profit", "total", lambda y: 180.0 + y - 2015)],
    "balance": [("Assets", "section", None), ("Inventories", "line", lambda y: 300.0), ("Cash and cash equivalents", "line", lambda y: 200.0 + y - 2015), ("Total assets", "total", lambda y: 500.0 + y - 2015), ("Equity", "section", None), ("Total equity", "total", lambda y: 320.0 + y - 2015), ("Total liabilities", "total", lambda y: 180.0)],
    "cashflow": [("Net profit", "line", lambda y: 180.0 + y - 2015), ("Net cash from operating activities", "subtotal", lambda y: 210.0), ("Cash and cash equivalents at the end of the year", "total", lambda y: 200.0 + y - 2015 + (40 if y == 2017 else 0))],
}


def published_module(path, issues):
    """FIRM as a data module: a statement of each kind and what validation says."""
    parts = []
    for kind, lines in FIRM.items():
        rows = [{"label": label, "kind": k} | ({"values": [f(y) for y in YEARS]} if f else {}) for label, k, f in lines]
        parts.append(f"export const {kind}Statement: Statement = {json.dumps({'periods': [f'12/31/{y}' for y in YEARS], 'rows': rows})};")
    status = "fail" if any(i["severity"] == "fail" for i in issues) else "warning" if issues else "pass"
    parts.append(f"export const validation: Validation = {json.dumps({'status': status, 'issues': issues})};")
    path.write_text("\n".join(parts))


def test_a_statement_as_published(spark, tmp_path):
    """The made-up company, and whatever published statements GOLDEN_STATEMENTS names, validate as published."""
    issue = {"severity": "warning", "period": "2017", "check": checking.CHECKS["cash"]}
    published_module(tmp_path / "firm.ts", [issue])
    urls = [("https://firm.test/docs/Annual%20Report%202019.pdf?x=1", "Annual Report 2019.pdf", "Annual Report", 2019), ("https://firm.test/q3-2020-statement.pdf", "q3-2020-statement.pdf", None, 2020), ("https://firm.test/esg/policy.pdf", "policy.pdf", None, None)]
    kinds = dict(spark.createDataFrame([(u,) for u, *_ in urls], "u string").select("u", U.classify_filing(F.col("u"))).collect())
    data = {"firm": [{"url": u, "title": t, "type": k or kinds[u], "year": y} for u, t, k, y in urls]}
    (tmp_path / "filings.ts").write_text(f"export const filings = {json.dumps(data)};")
    assert check_published(spark, sorted(map(str, tmp_path.glob("*.ts")))) == 2
    assert not GOLDEN or check_published(spark, GOLDEN) >= 3


def test_from_report_files_to_what_is_published(spark, tmp_path):
    """Nine reports of three columns each, one older figure restated, one line retired: read, compiled, validated, written
    and read back."""
    changed = ("Inventories", 2018, 2018)  # the line, the year, and the report that had another figure
    for y in YEARS[:-2]:
        out = {"year": y}
        for kind, lines in FIRM.items():
            columns = range(y, y - 3, -1)
            rows = [{"label": label, "kind": k, "values": [f(c) + (7 if (label, c, y) == changed else 0) for c in columns] if f else []} for label, k, f in lines]
            if kind == "income" and y < 2020:
                rows.insert(4, {"label": "Restructuring costs", "kind": "line", "values": [12.0] * 3})
            out[kind] = {"periods": [f"12/31/{c}" for c in columns], "rows": rows}
        (tmp_path / f"firm-{y}.extracted.json").write_text(json.dumps(out))
    r = sources.read_reports(spark, f"{tmp_path}/*.extracted.json")
    c = compiling.compile_statements(r, markers=True)
    got = {(x.kind, x.label, x.period_year): x.value for x in c.where("not historical and row_kind <> 'section'").collect()}
    assert got == {(kind, label, y): f(y) for kind, lines in FIRM.items() for label, _, f in lines if f for y in YEARS}
    assert by(c.where("restated"), "label", "period_year") == [("Inventories", 2018)]
    assert by(c.where("historical and value is not null"), "label", "period_year", "value") == sorted([("Restructuring costs", y, -12.0) for y in range(2015, 2020)], key=str)
    a = checking.audit_restatements(r).collect()
    assert [(x.label, x.period_year, x.used, x.original, [h.value for h in x.history]) for x in a] == [("Inventories", 2018, 300.0, 307.0, [300.0, 300.0, 307.0])]
    issues = checking.validate(c)
    assert by(issues, "check", "severity", "period_year", "diff") == [(checking.CHECKS["cash"], "warning", 2017, 40.0)]
    notes = by(checking.reconcile(c).where("kind = 'balance'"), "label", "period_year", "line_sum", "reported")
    assert notes == sorted([(label, y, 0.0, f(y)) for label, _, f in FIRM["balance"][5:] for y in YEARS], key=str)  # totals without lines above them
    status = checking.validation_status(issues, r)
    sources.write_statements(c.where("key is not null"), sources.source_list(r, spark.createDataFrame([], "slug string, year int, url string")), status, f"{tmp_path}/out", strict=True, buckets=4)
    back = sources.read_statements(spark, f"{tmp_path}/out", "firm")
    shown = {(x.kind, x.label): (x.periods, x["values"], x.restated_indices, x.status) for x in back.where("not historical").collect()}
    for kind, lines in FIRM.items():
        for label, _, f in lines:
            at = [YEARS.index(2018)] if label == "Inventories" else []
            assert shown[kind, label] == ([str(y) for y in YEARS], [f(y) if f else None for y in YEARS], at, "warning")
    assert [(x.kind, x.key) for x in compiling.display_order(back).where("place = 0").collect()] == [("balance", "asset@@total asset"), ("cashflow", "net profit"), ("income", "revenue")]
