"""Operators on small tables by hand."""

import random

from pyspark.sql import functions as F

from tallyframe import sources, streaming
from tallyframe.operators import checking, compiling, filings, locating, replies

SCHEMA = f"slug string, report_year int, kind string, periods array<string>, rows {compiling.ROWS}"
row = lambda label, kind, values: (label, kind, None, None, values)


def reports(spark, *rs):
    return spark.createDataFrame([("a", y, k, p, r) for y, k, p, r in rs], SCHEMA)


def by(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_balance_keys_and_first_rows(spark):
    r = reports(spark, (2020, "balance", ["2020"], [row("Borrowings", "line", [1.0]), row("Total non-current liabilities", "total", [1.0]), row("Borrowings", "line", [2.0]), row("Borrowings", "line", [3.0]), row("Total liabilities", "line", [3.0]), row("Notes", "line", [9.0])]))
    keys = [x["key"] for x in compiling.statement_rows(r, first_only=False).orderBy("pos").collect()]
    assert keys == ["borrowing@@total non current liability", "total non current liability@@total liability", "borrowing@@total liability", "borrowing@@total liability", "total liability", "note"]
    assert by(compiling.explode_cells(r), "pos") == [(0,), (1,), (2,), (4,), (5,)]


def test_newest_wins_restated_historical(spark):
    r = reports(
        spark, (2021, "income", ["2021", "2020"], [row("Revenue", "line", [20.0, 11.0]), row("Cost of sales", "line", [-5.0, None])]),
        (2020, "income", ["12/31/2020", "2020"], [row("Revenues", "line", [10.0, 77.0]), row("Costs of sales", "line", [4.0]), row("Old line", "line", [1.0, 2.0]), row("Part", "section", [])]),
    )
    c = by(compiling.compile_statements(r), "ord", "label", "period_year", "value", "restated", "historical")
    assert c == [
        (0, "Revenue", 2020, 11.0, True, False), (0, "Revenue", 2021, 20.0, False, False), (1, "Cost of sales", 2020, -4.0, False, False), (1, "Cost of sales", 2021, -5.0, False, False),
        (2, "Old line", 2020, 1.0, False, True), (2, "Old line", 2021, None, False, True), (3, "Part", 2020, None, False, False), (3, "Part", 2021, None, False, False),
    ]
    w = compiling.to_wide(compiling.compile_statements(r)).where("ord = 0").first()
    assert (w["periods"], w["values"], w["restated_indices"]) == (["2021", "2020"], [20.0, 11.0], [1])
    assert by(compiling.latest_periods(compiling.compile_statements(r), 1), "period_year") == [(2021,)] * 4


def test_empty_newest_report_makes_all_historical(spark):
    r = reports(spark, (2022, "income", [], []), (2021, "income", ["2021"], [row("Revenue", "line", [1.0])]))
    assert by(compiling.compile_statements(r), "label", "historical") == [("Revenue", True)]


def test_order_of_rows_does_not_matter(spark):
    rs = [(y, "income", [str(y), str(y - 1)], [row(x, "line", [float(y), float(y - i)]) for i, x in enumerate("abc")]) for y in range(2015, 2021)]
    want = by(compiling.compile_statements(reports(spark, *rs)), *["key", "period_year", "value", "restated", "ord"])
    random.Random(1).shuffle(rs)
    assert by(compiling.compile_statements(reports(spark, *rs).repartition(3)), *["key", "period_year", "value", "restated", "ord"]) == want


def test_one_pass_equals_joins(spark):
    from tallyframe.jobs import derive

    r = derive.reports(spark, "/root/testdata/sf0.001")
    grid = compiling.templates(r).join(compiling.statement_years(r), ["slug", "kind"], "left")
    joined = grid.join(compiling.newest_values(r), ["slug", "kind", "key", "period_year"], "left").select("slug", "kind", "ord", "key", "period_year", F.abs("value").alias("v"), "historical")
    one = compiling.compile_statements(r).select("slug", "kind", "ord", "key", "period_year", F.abs("value").alias("v"), "historical")
    assert one.exceptAll(joined).count() == 0 and joined.exceptAll(one).count() == 0


def test_validation(spark):
    total = lambda a, b: [row("Total assets", "total", [a]), row("Total equity", "total", [b / 2]), row("Total liabilities", "total", [b / 2]), row("Cash", "line", [5.0])]
    r = reports(spark, (2020, "balance", ["2020"], total(1000.0, 900.0)), (2020, "income", ["2020"], [row("Sales", "line", [7.0]), row("Net income", "total", [3.0])]), (2020, "cashflow", ["2020"], [row("Net profit", "line", [3.5]), row("Cash dividends paid at end", "line", [50.0])]))
    v = checking.validate(compiling.compile_statements(r))
    assert by(v, "check", "severity", "diff") == sorted([(checking.CHECKS["balance"], "fail", 100.0), (checking.CHECKS["cash"], "warning", 45.0), (checking.CHECKS["no_cashflow"], "fail", 0.0)], key=str)
    both = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert by(checking.validation_status(v, both), "slug", "status") == [("a", "fail"), ("b", "pass")]


def test_reconcile_and_audit(spark):
    r = reports(spark, (2021, "income", ["2021", "2020"], [row("A", "line", [1.0, 2.0]), row("B", "line", [2.0, None]), row("Sum", "subtotal", [9.0, 2.0]), row("Sum two", "total", [5.0, 5.0])]), (2020, "income", ["2020"], [row("A", "line", [4.0])]))
    n = checking.reconcile(compiling.compile_statements(r))
    assert by(n, "label", "period_year", "line_sum", "reported") == [("Sum two", 2020, 0.0, 5.0), ("Sum two", 2021, 0.0, 5.0), ("Sum", 2021, 3.0, 9.0)]
    a = checking.audit_restatements(r)
    assert by(a, "key", "period_year", "used", "used_report", "original", "original_report") == [("a", 2020, 2.0, 2021, 4.0, 2020)]
    assert by(checking.restatement_count(a), "slug", "n_restated") == [("a", 1)]


def test_spans_equal_a_plain_loop(spark):
    rng, kinds = random.Random(5), ["income", "balance", "cashflow"]
    pages, picks, want = [], [], set()
    heads = {"income": "income statement", "balance": "balance sheet", "cashflow": "cash flow statement"}
    for rep in range(40):
        n = rng.randrange(1, 8)
        texts = [rng.choice(["", "", "", *heads.values(), "changes in equity"]) for _ in range(n)]
        pages += [(f"s{rep}", 2000, i, t) for i, t in enumerate(texts)]
        own = {k: rng.randrange(n) for k in kinds if rng.random() < 0.8}
        picks += [(f"s{rep}", 2000, k, p) for k, p in own.items()]
        claimed = set(own.values())
        for k in sorted(own, key=lambda k: (own[k], kinds.index(k))):
            bad = [h for o, h in heads.items() if o != k] + ["changes in equity"]
            for nb in (own[k] - 1, own[k] + 1):
                if 0 <= nb < n and nb not in claimed and not any(h in texts[nb] for h in bad):
                    claimed.add(nb)
                    want.add((f"s{rep}", k, nb))
            want.add((f"s{rep}", k, own[k]))
    got = locating.statement_spans(spark.createDataFrame(picks, "slug string, report_year int, kind string, page_index int"), spark.createDataFrame(pages, "slug string, report_year int, page_index int, text string"))
    assert {(r.slug, r.kind, r.page_index) for r in got.collect()} == want


def test_replies(spark):
    cases = [
        ("a", '```json\n{"periods":["2020","2019"],"rows":[{"label":"R","kind":"line","values":[1]},{"kind":"line"},{"label":"S","kind":"section"},{"label":"T","kind":"total","values":[1,"x",3]}]}\n```'),
        ("b", '{"periods":["2020"'), ("c", None), ("d", "no json"), ("e", 'text {"periods":[],"rows":[{"label":"R","kind":"line","values":[1,2]}]} end'),
    ]
    r = replies.parse_replies(spark.createDataFrame([(s, 2020, "income", t) for s, t in cases], "slug string, report_year int, kind string, reply string"))
    got = {x.slug: (x.periods, [(y.label, y["values"]) for y in x.rows], x.n_mismatched) for x in r.collect()}
    assert got == {"a": (["2020", "2019"], [("R", [1.0, None]), ("S", []), ("T", [1.0, None])], 2), "b": ([], [], 0), "c": ([], [], 0), "d": ([], [], 0), "e": ([], [("R", [1.0, 2.0])], 0)}


def test_reply_json(spark):
    cases = {"": None, "} {": None, "{}": "{}", '```json\n{"a":1}\n```': '{"a":1}', 'So {"a":{\n"b":2}}\u00a0. Done': '{"a":{\n"b":2}}', "{a} {b": None, "\u3000```JSON [1,2]```\n": "[1,2]", "{": None, '{"a":1': None}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert {r.t: r.j for r in df.select("t", replies.reply_json(F.col("t")).alias("j")).collect()} == cases | {None: None}


def test_boilerplate_and_english(spark):
    pages = [("s", 2000, i, f"Header | page {i}\nbody text {i}  Header") for i in range(8)]
    df = spark.createDataFrame(pages, "slug string, report_year int, page_index int, text string")
    assert by(locating.boilerplate_segments(df), "seg", "n_pages") == [("Header", 8)]
    assert by(locating.strip_boilerplate(df).where("page_index = 2"), "text") == [("page 2 body text 2",)]
    assert by(locating.looks_english(df), "english") == [(True,)]


def test_catalog(spark):
    links = [("f", 0, 0, "https://ir.firm.test/annual-report-2020.pdf"), ("f", 0, 1, "https://ir.firm.test/annual-report-2020.pdf"), ("f", 1, 0, "https://other.test/x.pdf"), ("f", 1, 1, "https://ir.firm.test/financial-statements-2019.pdf"), ("f", 1, 2, "https://ir.firm.test/esg-2020.pdf")]
    links = spark.createDataFrame(links, "slug string, page_ord int, ord int, href string")
    companies = spark.createDataFrame([("f", ["firm"])], "slug string, hosts array<string>")
    d = spark.createDataFrame([("f", 2018, "https://elsewhere.test/abc"), ("f", 2020, "https://ir.firm.test/annual-report-2020.pdf")], "slug string, year int, url string")
    c = filings.catalog_filings(links, companies, d)
    assert by(c, "ord", "year", "type") == [(0, 2020, "Annual Report"), (1, 2020, "ESG / Sustainability"), (2, 2019, "Financial Statements"), (3, 2018, "Other")]
    assert by(filings.fill_discovered(c, d), "year") == [(2018,), (2019,), (2020,)]
    assert by(filings.mark_used(c, d), "ord", "used") == [(0, True), (1, False), (2, False), (3, True)]
    assert by(filings.filings_by_type(c), "type", "n")[0] == ("All", 4)


def test_files_and_refresh(spark, tmp_path):
    import json

    s = {"periods": ["2020"], "rows": [{"label": "Revenue", "kind": "line", "values": [1.0]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/my-firm-2020.extracted.json").write_text(json.dumps({"year": 2020, "income": s, "balance": {"periods": [], "rows": []}}))
    (tmp_path / "in/my-firm-2020.pages.json").write_text(json.dumps({"year": 2020, "pages": ["a", "b"]}))
    r = sources.read_reports(spark, f"{tmp_path}/in/*.extracted.json")
    assert by(r, "slug", "report_year", "kind") == [("my-firm", 2020, "balance"), ("my-firm", 2020, "cashflow"), ("my-firm", 2020, "income")]
    assert by(sources.read_pages(spark, f"{tmp_path}/in/*.pages.json"), "page_index", "text") == [(0, "a"), (1, "b")]
    where = [f"{tmp_path}/{n}" for n in ("new", "reports", "compiled", "checkpoint")]
    r.write.parquet(where[0])
    streaming.refresh_incremental(spark, *where, buckets=2)
    later = r.withColumn("report_year", F.lit(2021)).withColumn("periods", F.transform("periods", lambda p: F.lit("2021")))
    later.write.mode("append").parquet(where[0])
    streaming.refresh_incremental(spark, *where, buckets=2)
    got = sources.read_published(spark, where[2])
    assert by(got, "kind", "period_year", "value") == [("income", 2020, 1.0), ("income", 2021, 1.0)]
    assert by(streaming.pending_reports(later.select("slug", "report_year").distinct(), r), "report_year") == [(2021,)]
    status = spark.createDataFrame([("my-firm", "fail")], "slug string, status string")
    src = sources.source_list(r, spark.createDataFrame([], "slug string, year int, url string"))
    c = compiling.compile_statements(r)
    sources.write_statements(c, src, status, f"{tmp_path}/out")
    assert sources.read_statements(spark, f"{tmp_path}/out").count() == 1
    assert sources.write_statements(c, src, status, f"{tmp_path}/out2", strict=True, dry_run=True).count() == 0
    sources.write_validation(checking.validate(c), status, f"{tmp_path}/validation")
    assert sources.read_validation(spark, f"{tmp_path}/validation").first()["status"] == "fail"


def test_reports_are_made_without_long_cells(spark):
    from tallyframe.jobs import derive

    sf_dir = "/root/testdata/sf0.001"
    made, cells = derive.reports(spark, sf_dir), derive.as_reports(derive.cells(spark, sf_dir), range(3))
    assert made.schema == cells.schema and made.exceptAll(cells).isEmpty() and cells.exceptAll(made).isEmpty()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("lineitem.parquet") == 1 and "Union" not in plan


def test_keys_of_whole_arrays_of_labels(spark):
    from pyspark.sql import functions as F

    from tallyframe.functions import labels as L

    given = ["Profit (loss) on X, (b.3)", "Net cash flows from Taxes", "Boxes ss ies s xes", "", " ", "(1)", "—", "\t%\x0b", "Ärzte (2)", "\u212aosts", "İs", "Total Revenues", "total revenue\n", "Cost1 for the financial year", "a\x1cb_c1", None, "((1)x(loss)", "Σς", "\u00a0A\u00a0"]
    df = spark.createDataFrame([(given,), ([],), (None,)], "x array<string>")
    got = [r.k for r in df.select(L.canon_keys(F.col("x")).alias("k")).collect()]
    assert got == [[r.k for r in spark.createDataFrame([(x,) for x in given], "x string").select(L.canon_key(F.col("x")).alias("k")).collect()], [], []]


def test_compiled_equals_its_parts(spark):
    from pyspark.sql import functions as F

    from tallyframe.operators import compiling

    row = lambda label, kind, *v: (label, kind, "currency", 0, list(v))
    given = [
        ("a", 2020, "income", ["2020", "x", "2019", "2020"], [row("Costs", "line", 1.0, 9.0, -2.0, 7.0), row("Cost", "line", 5.0), row(None, "line", 1.0), row("Sales", "line", None, None, float("nan"))]),
        ("a", 2019, "income", ["2019", "2018"], [row("Cost", "line", 2.0, 4.0), row("Sales", "line", 3.0, -0.0), row("Old", "line", 1.0, 1.0), row("Head", "section")]),
        ("a", 2018, "income", ["2018"], [row("Sale", "line", 0.0)]),
        ("b", 2020, "balance", ["2020"], []), ("b", 2019, "balance", [], [row("Total assets", "total", 1.0)]),
        ("c", 2020, "cashflow", [], [row("Cash", None, 1.0)]),
    ]
    r = spark.createDataFrame(given, f"slug string, report_year int, kind string, periods array<string>, rows {compiling.ROWS}")
    got = compiling.compile_statements(r)
    parts = compiling.templates(r).join(compiling.statement_years(r), ["slug", "kind"], "left").join(compiling.newest_values(r), ["slug", "kind", "key", "period_year"], "left")
    cost, shown = compiling.is_expense_label(F.col("label")) & (F.col("kind") == "income"), compiling.clean_label(F.col("label"))
    parts = parts.select("slug", "kind", "ord", "key", shown.alias("label"), "row_kind", "unit", "decimals", "period_year", F.when(cost & (F.col("value") > 0), -F.col("value")).otherwise(F.col("value")).alias("value"),
        F.coalesce(F.when(cost, F.col("differs_as_cost")).otherwise(F.col("differs")), F.lit(False)).alias("restated"), "historical")
    assert sorted(map(str, got.collect())) == sorted(map(str, parts.collect()))


def test_replies_are_read_once(spark):
    from tallyframe.jobs import queries

    df = queries.replies_to_statements(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("lineitem.parquet") == 1


def exchanges(df):
    """What is shuffled by key, in a plan without broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def made(spark):
    from tallyframe.jobs import derive

    return derive.reports(spark, "/root/testdata/sf0.001")


def test_wide_rows_equal_the_wide_form_of_cells(spark):
    r = reports(spark, (2021, "income", ["2021", "2020", "x"], [row("Revenue", "line", [20.0, 11.0]), row("Cost", "line", [None, 5.0])]), (2020, "income", ["2020", "2019"], [row("Revenue", "line", [10.0]), row("Old", "line", [1.0, 2.0])]), (2020, "balance", [], [row("Cash", "line", [])]))
    r = r.unionByName(made(spark).where("slug < 'c3'"))
    for n in (None, 1, 3):
        c = compiling.compile_statements(r)
        want = compiling.to_wide(c if n is None else compiling.latest_periods(c, n))
        assert sorted(map(str, compiling.compile_wide(r, n).collect())) == sorted(map(str, want.collect()))
    places = compiling.with_places(compiling.compile_wide(r))
    assert sorted(map(str, places.collect())) == sorted(map(str, compiling.display_order(compiling.to_wide(c)).collect() if n is None else compiling.display_order(compiling.to_wide(compiling.compile_statements(r))).collect()))


def test_reports_by_company_are_not_shuffled_again(spark):
    r = made(spark)
    assert exchanges(compiling.compile_statements(r)) == exchanges(compiling.compile_wide(r)) == exchanges(checking.audit_restatements(r)) == exchanges(r)


def test_status_of_all_companies_in_one_pass(spark):
    empty = spark.createDataFrame([("b", 2020, "income", [], []), ("c", 2020, "income", ["2020"], [])], SCHEMA)
    r = made(spark).unionByName(empty).unionByName(reports(spark, (2020, "income", ["2020"], [row("Revenue", "line", [1.0])])))
    want = checking.validation_status(checking.validate(compiling.compile_statements(r, markers=True)), r)
    got = checking.company_status(compiling.compile_statements(r, every=True))
    assert by(got, "slug", "status") == by(want, "slug", "status") and {("a", "pass"), ("b", "pass"), ("c", "fail")} <= set(by(got, "slug", "status"))
    from tallyframe.jobs import queries

    q = queries.validation_status(spark, "/root/testdata/sf0.001")
    assert q._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1


def test_audit_of_repeats_signs_and_rows_without_label(spark):
    r = reports(
        spark,
        (2021, "income", ["2021", "2020", "FY2020", None], [row("Costs", "line", [3.0, 2.0, 4.0]), row("A", "line", [1.0]), row("As", "line", [2.0]), row(None, "line", [5.0]), row(None, "line", [6.0])]),
        (2020, "income", ["2020"], [row("Cost (1)", "line", [-2.0]), row("A", "line", [7.0])]), (2022, "income", ["?"], [row("A new", "line", [1.0]), row("A", "section", [])]),
    )
    a = by(checking.audit_restatements(r), "key", "label", "period_year", "used", "used_report", "original", "original_report", "history")
    h = lambda *xs: str([(y, v) for y, v in xs])
    assert [(*x[:7], str([tuple(y) for y in x[7]])) for x in a] == sorted([
        (None, None, 2021, 5.0, 2021, 6.0, 2021, h((2021, 5.0), (2021, 6.0))),
        ("cost", "Costs", 2020, -2.0, 2021, -2.0, 2020, h((2021, -2.0), (2021, -4.0), (2020, -2.0))),
    ], key=str)


def test_recompiling_equals_merging_and_joining(spark):
    a = lambda y, v, slug="a": (slug, y, "income", [str(y)], [row("Revenue", "line", [v])])
    stored = spark.createDataFrame([a(2019, 1.0), a(2020, 2.0), a(2020, 1.0, "b"), a(2020, 9.0, "d"), a(None, 4.0)], SCHEMA)
    new = spark.createDataFrame([a(2020, 5.0), a(2020, 7.0), a(2021, 3.0, "c"), a(None, 3.0), a(2018, 2.0, None)], SCHEMA)
    for old, late in ((stored, new), (made(spark).where("report_year < 2002"), made(spark).where("report_year >= 2002"))):
        want = compiling.compile_statements(streaming.merge_reports(old, late).join(late.select("slug").distinct(), "slug", "left_semi"))
        assert sorted(map(str, streaming.recompile_touched(old, late).collect())) == sorted(map(str, want.collect()))
    assert exchanges(streaming.recompile_touched(old, late)) == 2 * exchanges(late)


def odd(spark):
    """Reports with odd rows and columns, beside those made of the smallest size."""
    r = reports(
        spark,
        (2021, "income", ["2021", "2020", "x", "2020"], [row("A", "line", [1.0, 2.0]), row("B", None, [2.0, None]), row("Sum", "subtotal", [9.0, 2.0]), row("C", "line", [float("nan")]), row("Net profit", "total", [5.0, 5.0, 1.0, 9.0])]),
        (2020, "income", ["2020"], [row("A", "line", [4.0]), row("\u00c4rger 1", "line", [3.0]), row("Revenue", "total", [-0.0]), row(None, "line", [1.0])]),
        (2021, "balance", ["2021", "2019"], [row("Total assets", "total", [7.0, None]), row("Total assets", "total", [8.0, 3.0]), row("Cash", "line", [1.0, 1.0]), row(" Total equity", "line", [2.0, 2.0]), row("Total liabilities", "subtotal", [2.0, 2.0])]),
        (2021, "cashflow", ["2021", "2018"], []), (2020, "notes", ["2017"], [row("Cash at the end", "line", [1.0])]), (2020, "balance", [], [row("Sum", "total", [1.0])]),
    )
    empty = spark.createDataFrame([("b", 2020, "income", [], []), ("c", 2020, "income", ["2020"], []), ("d", 2020, "balance", ["2020"], [row("Other", "line", [1.0])])], SCHEMA)
    return made(spark).unionByName(r).unionByName(empty)


def test_status_beside_statements_compiled_once(spark):
    r = odd(spark)
    found = checking.with_status(compiling.compile_found(r))
    assert by(found.select("slug", "status").distinct(), "slug", "status") == by(checking.company_status(compiling.compile_statements(r, every=True)), "slug", "status")
    cells = compiling.found_cells(found, False, "status").drop("status")
    assert sorted(map(str, cells.collect())) == sorted(map(str, compiling.compile_statements(r).select(*cells.columns).collect()))
    from tallyframe.jobs import queries

    plan = queries.replies_to_statements(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == plan.count("from_json") == 1


def test_facts_of_whole_arrays_of_labels(spark):
    from tallyframe.functions import labels as L

    given = ["Cost (D.2) , (b.3)", "Income taxes1", "Other income and expense", "a1b c22", "  Costs1  of\t\tsales ", "Gross costs", "", "(1)", "\u00c4rztekosten1 cost", "\x0bExpenses\x0c(2)", None, "Net loss_costs", "COSTS", "(x.12)Cost_ expense"]
    df = spark.createDataFrame([(given,), ([],), (None,)], "x array<string>")
    got = [[tuple(f) for f in r.f] for r in df.select(L.label_facts(F.col("x")).alias("f")).collect()]
    x = F.col("x")
    want = spark.createDataFrame([(x,) for x in given], "x string").select(L.canon_key(x), L.clean_label(x), L.is_expense_label(x), L.is_expense_label(L.clean_label(x))).collect()
    assert got == [[tuple(r) for r in want], [], []]


def test_subtotals_are_reconciled_where_statements_lie(spark):
    r = odd(spark)
    shown = lambda df: sorted(map(str, df.select("slug", "kind", "ord", "label", "period_year", "line_sum", "reported").collect()))
    n = shown(checking.reconcile_found(compiling.compile_found(r)))
    assert n == shown(checking.reconcile(compiling.compile_statements(r))) and "label='Sum'" in str(n)
    from tallyframe.jobs import queries

    assert exchanges(queries.subtotal_notes(spark, "/root/testdata/sf0.001")) == exchanges(made(spark))
