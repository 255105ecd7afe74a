"""Accounting identities, coverage, subtotals, and the audit of restatements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.labels import let, strip
from tallyframe.operators.compiling import statements

#: Names of the net profit line.
NET_PROFIT = ["net profit", "net income", "profit for the year", "profit for the period", "profit after tax", "profit after taxes", "earnings after taxes", "consolidated net income"]
#: What the other headline figures are called (whole labels, or what a label holds).
BOTH = ["total equity and liabilities", "total liabilities and equity"]
CASH_PARTS, CASH = ["cash and cash equivalents", "cash at bank"], "cash"
REVENUE = ["revenue", "sales", "turnover", "total operating performance"]
OPERATING = "operating activities"
#: Names of the checks.
CHECKS = {
    "balance": "balance sheet balances (assets = equity + liabilities)",
    "profit": "net profit matches (income vs cash flow)",
    "cash": "ending cash matches (cash flow vs balance sheet)",
    "no_income": "income: no revenue/sales value (wrong page?)",
    "no_balance": "balance: no total assets value (wrong page?)",
    "no_cashflow": "cashflow: no operating-activities value (wrong page?)",
}


def find_value(kind: str, match: Column) -> Column:
    """Aggregate over a company's cells of one period: the value of the first row of that kind, in order, that matches
    and has one."""
    return F.min(F.when((F.col("kind") == kind) & match & F.col("value").isNotNull(), F.struct("ord", "value")))["value"]


#: The headline figures of each kind of statement, and which labels (in lower case) they go by.
HEADLINES = {
    "income": {"profit": lambda low: low.isin(NET_PROFIT), "revenue": lambda low: low.rlike("|".join(REVENUE))},
    "balance": {
        "assets": lambda low: low == "total assets", "both": lambda low: low.isin(BOTH), "equity": lambda low: low == "total equity", "liabilities": lambda low: low == "total liabilities",
        "cash": lambda low: low.contains(CASH_PARTS[0]) | low.contains(CASH_PARTS[1]) | (low == CASH),
    },
    "cashflow": {"cash_profit": lambda low: low.isin(NET_PROFIT), "ending_cash": lambda low: low.contains("cash") & low.contains("end"), "operating": lambda low: low.contains(OPERATING)},
}


def headline_values(compiled: DataFrame, every: bool = False) -> DataFrame:
    """The figures that the checks compare, for each slug and period_year (null too if every), in one aggregate."""
    low = F.lower(strip(F.col("label")))
    c = (compiled if every else compiled.where("period_year is not null")).withColumn("low", low)
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    return c.groupBy("slug", "period_year").agg(
        *[find_value(kind, match(F.col("low"))).alias(name) for kind, names in HEADLINES.items() for name, match in names.items()], *[has(kind).alias(f"has_{kind}") for kind in HEADLINES]
    )


def validate(compiled: DataFrame) -> DataFrame:
    """Issues of compiled statements: slug, check, severity, period_year, expected, actual, diff.

    Identities compare within the greater of 1 and half a percent; coverage asks each statement's headline in each of its
    years. Statements that have years but no row count if compile_statements gave markers of them. One aggregate.
    """
    v = headline_values(compiled)
    out = v.select("slug", "period_year", F.explode(_issues()).alias("x"))
    return out.select("slug", "x.check", "x.severity", "period_year", "x.expected", "x.actual", "x.diff")


def _issues(v: Callable[[str], Column] = F.col) -> Column:
    """The issues of a row of headline_values, or of any such figures by name."""
    both = F.coalesce(v("both"), v("equity") + v("liabilities"))
    off = lambda a, b: F.abs(a - b) > F.greatest(F.lit(1.0), F.abs(b) * 0.005)
    issue = lambda name, severity, expected, actual: F.struct(
        F.lit(CHECKS[name]).alias("check"), F.lit(severity).alias("severity"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), (actual - expected).cast("double").alias("diff")
    )
    zero = F.lit(0.0)
    found = [
        F.when(off(v("assets"), both), issue("balance", "fail", both, v("assets"))),
        F.when(v("has_income") & off(v("profit"), v("cash_profit")), issue("profit", "fail", v("profit"), v("cash_profit"))),
        F.when(v("has_balance") & off(v("cash"), v("ending_cash")), issue("cash", "warning", v("cash"), v("ending_cash"))),
        F.when(v("has_income") & v("revenue").isNull(), issue("no_income", "fail", zero, zero)),
        F.when(v("has_balance") & v("assets").isNull(), issue("no_balance", "fail", zero, zero)),
        F.when(v("has_cashflow") & v("operating").isNull(), issue("no_cashflow", "fail", zero, zero)),
    ]
    return F.array_compact(F.array(*found))


def validation_status(issues: DataFrame, companies: DataFrame) -> DataFrame:
    """slug, status of each company: fail if any issue fails, warning if there is any, else pass."""
    per = issues.groupBy("slug").agg(F.max((F.col("severity") == "fail").cast("int")).alias("failed"))
    status = F.when(F.col("failed") == 1, "fail").when(F.col("failed") == 0, "warning").otherwise("pass")
    return companies.select("slug").distinct().join(per, "slug", "left").select("slug", status.alias("status"))


def company_status(compiled: DataFrame) -> DataFrame:
    """validation_status of validate(compiled) for the companies of compiled, in one pass over it. With `every` of
    compile_statements these are all companies that have reports."""
    found = F.when(F.col("period_year").isNotNull(), _issues()["severity"])
    failed = F.when(F.array_contains(found, "fail"), 1).when(F.size(found) > 0, 0)
    per = headline_values(compiled, every=True).select("slug", failed.alias("failed")).groupBy("slug").agg(F.max("failed").alias("failed"))
    return per.select("slug", F.when(F.col("failed") == 1, "fail").when(F.col("failed") == 0, "warning").otherwise("pass").alias("status"))


def with_status(found: DataFrame) -> DataFrame:
    """What compile_found gives with its company's status, the one that company_status tells of the same statements with
    their markers. A company's statements become one row, so that they aren't made a second time to be checked."""

    def heads(kind: str, s: Column) -> Column:
        """For each year of a statement of that kind its headline figures, each of the first row that has one."""
        rows = lambda low, match: F.filter(s["found"], lambda x, i: match(F.get(low, i)))["cells"]
        first = lambda m, i: F.get(F.array_compact(F.transform(m, lambda cells: F.get(cells, i)["value"])), F.lit(0))
        told = lambda m: F.transform(s["years"], lambda y, i: F.struct(y.alias("year"), F.transform(m, lambda x: first(x, i)).alias("values")))
        return let(F.transform(s["found"], lambda x: F.lower(strip(x["label"]))), lambda low: let(F.array(*[rows(low, match) for match in HEADLINES[kind].values()]), told))

    def severities(year: Column, h: Column) -> Column:
        own = lambda kind: F.get(F.filter(h[kind], lambda x: x["year"] == year), F.lit(0)).alias(kind)
        at = {name: (kind, i) for kind, names in HEADLINES.items() for i, name in enumerate(names)}
        value = lambda o: lambda name: F.get(o[at[name][0]]["values"], F.lit(at[name][1])) if name in at else o[name.removeprefix("has_")].isNotNull()
        return let(F.struct(*[own(kind) for kind in HEADLINES]), lambda o: _issues(value(o))["severity"])

    def status(statements: Column) -> Column:
        own = lambda kind: F.get(F.filter(statements, lambda s: s["kind"] == kind), F.lit(0))["heads"].alias(kind)
        years = F.array_distinct(F.flatten(statements["years"]))
        found = let(F.struct(*[own(kind) for kind in HEADLINES]), lambda h: F.flatten(F.transform(years, lambda year: severities(year, h))))
        return let(found, lambda x: F.when(F.array_contains(x, "fail"), "fail").when(F.size(x) > 0, "warning").otherwise("pass"))

    own = lambda kind: F.when(F.col("kind") == kind, let(F.struct("years", "found"), lambda s: heads(kind, s)))
    told = F.coalesce(*[own(kind) for kind in HEADLINES])
    c = found.select("slug", F.struct("kind", "years", "found", told.alias("heads")).alias("s")).groupBy("slug").agg(F.collect_list("s").alias("statements"))
    c = c.select("slug", let(F.col("statements"), lambda x: F.struct(status(x).alias("status"), x.alias("statements"))).alias("x"))
    return c.select("slug", "x.status", F.inline_outer("x.statements")).select("slug", "status", "kind", "years", "found")


def reconcile(compiled: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Subtotals and totals that aren't the sum of the lines since the last row that is no line: slug, kind, ord, label,
    period_year, line_sum, reported. A missing figure counts as 0 among the lines."""
    c = compiled.where("period_year is not null").select("slug", "kind", "ord", "label", "row_kind", "period_year", "value")
    line = F.coalesce(F.col("row_kind") == "line", F.lit(False))  # a row of unknown kind ends a block like any other
    before = Window.partitionBy("slug", "kind", "period_year").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("block", F.coalesce(F.sum((~line).cast("int")).over(before), F.lit(0)))
    b = c.groupBy("slug", "kind", "period_year", "block").agg(
        F.sum(F.when(line, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("line_sum"), F.max(F.when(F.col("row_kind").isin("subtotal", "total"), F.struct("ord", "label", "value"))).alias("t")
    )
    b = b.where(F.abs(F.col("line_sum") - F.col("t.value")) > tolerance)
    return b.select("slug", "kind", "t.ord", "t.label", "period_year", "line_sum", F.col("t.value").alias("reported"))


def reconcile_found(found: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """reconcile of what compile_found gives. All rows of a statement have a cell for each of its years, so that a fold over
    its rows carries the sums of all years, and neither cells nor rows are dealt out, sorted or shuffled."""
    zeros = F.transform("years", lambda y: F.lit(0.0))
    kept = {f.name: f.dataType.simpleString() for f in found.schema["found"].dataType.elementType if f.name in ("ord", "label", "cells")}
    none = F.array().cast(f"array<struct<ord:{kept['ord']},label:string,sums:array<double>,cells:{kept['cells']}>>")
    state = lambda sums, totals: F.struct(sums.alias("sums"), totals.alias("totals"))

    def step(at: Column, x: Column) -> Column:
        line = F.coalesce(x["row_kind"] == "line", F.lit(False))  # a row of unknown kind ends a block like any other
        total = F.struct(x["ord"].alias("ord"), x["label"].alias("label"), at["sums"].alias("sums"), x["cells"].alias("cells"))
        totals = F.when(x["row_kind"].isin("subtotal", "total"), F.concat(at["totals"], F.array(total))).otherwise(at["totals"])
        more = F.zip_with(at["sums"], x["cells"], lambda a, c: a + F.coalesce(c["value"], F.lit(0.0)))
        return F.when(line, state(more, at["totals"])).otherwise(state(zeros, totals))

    totals = F.aggregate("found", state(zeros, none), step, lambda at: at["totals"])
    t = found.select("slug", "kind", F.inline_outer(totals)).select("slug", "kind", "ord", "label", F.inline_outer(F.arrays_zip("sums", "cells")))
    t = t.select("slug", "kind", "ord", "label", "cells.period_year", F.col("sums").alias("line_sum"), F.col("cells.value").alias("reported"))
    return t.where(F.abs(F.col("line_sum") - F.col("reported")) > tolerance)


def audit_restatements(reports: DataFrame) -> DataFrame:
    """Every cell whose value differs between reports: slug, kind, key, label, period_year, used (of the newest report),
    used_report, original (of the oldest), original_report, history (report, value; newest first).

    Costs are made negative by each row's own label on statements of any kind. Repeated keys and years within a report
    all count, unlike in compile_statements.
    """
    s = statements(reports)
    column = lambda y, i: F.when(y.isNotNull(), F.struct(y.alias("year"), i.alias("col")))
    own_columns = lambda x: F.array_compact(F.transform(x["years"], column))
    again = lambda x: F.size(F.array_distinct(F.array_compact(x["keys"]))) < F.size(x["keys"])
    forms = lambda d: F.transform(d["forms"], lambda f: F.struct(f["keys"].alias("keys"), again(f).alias("again")))
    costs = lambda d, x: F.transform(x["rows"]["label"], lambda label: F.try_element_at(d["facts"], label)["cost"])
    own = lambda d, x, f: F.struct(x["old"].alias("old"), f["keys"].alias("keys"), x["rows"].alias("rows"), costs(d, x).alias("costs"), own_columns(x).alias("columns"), f["again"].alias("again"))
    given = lambda d: let(forms(d), lambda forms: F.transform(d["reports"], lambda x: own(d, x, F.get(forms, x["form"]))))
    s = s.select("slug", "kind", let(F.col("x"), given).alias("reports"))

    def entries(x: Column, key: Column) -> Column:
        """A report's rows of a key, all of them if it has several."""
        at = F.array_position(x["keys"], key)
        places = F.when(x["again"], F.array_compact(F.transform(x["keys"], lambda k, i: F.when(k.eqNullSafe(key), i)))).when(at > 0, F.array((at - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(x["old"].alias("old"), i.alias("pos"), x["columns"].alias("columns"), F.get(x["rows"], i).alias("row"), F.get(x["costs"], i).alias("cost")))

    def figure(o: Column, c: Column) -> Column:
        sign = lambda v: F.when(o["cost"] & (v > 0), -v).otherwise(v)
        given = lambda v: F.when(v.isNotNull(), F.struct(c["year"].alias("year"), o["old"].alias("y"), o["pos"].alias("pos"), c["col"].alias("col"), sign(v).alias("value")))
        return let(F.get(o["row"]["values"], c["col"]), given)

    def differs(cells: Column) -> Column:
        """Whether two figures of one year differ: they are neighbours in order."""
        apart = lambda p: F.exists(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce((a["year"] == b["year"]) & (a["value"] != b["value"]), F.lit(False))), lambda x: x)
        return let(F.sort_array(F.transform(cells, lambda c: F.struct(c["year"].alias("year"), c["value"].alias("value")))), apart)

    def audited(key: Column, given: Column) -> Column:
        own = F.flatten(F.transform(given, lambda x: entries(x, key)))
        cells = lambda own: F.flatten(F.transform(own, lambda o: F.array_compact(F.transform(o["columns"], lambda c: figure(o, c)))))
        # a key's name is that of its newest cell of any year
        name = lambda own: F.array_max(F.transform(F.filter(own, lambda o: F.size(o["columns"]) > 0), lambda o: F.struct((-o["old"]).alias("report_year"), (-o["pos"]).alias("pos"), o["row"]["label"].alias("label"))))["label"]
        return let(own, lambda own: let(cells(own), lambda c: F.when(differs(c), F.struct(key.alias("key"), name(own).alias("label"), c.alias("cells")))))

    found = let(F.col("reports"), lambda given: F.array_compact(F.transform(F.array_distinct(F.flatten(given["keys"])), lambda key: audited(key, given))))
    # outer generators, so that no filter on all of it is inferred and run beside it
    a = s.select("slug", "kind", found.alias("found")).select("slug", "kind", F.inline_outer("found")).where("cells is not null")
    a = a.select("slug", "kind", "key", "label", "cells", F.explode_outer(F.array_distinct("cells.year")).alias("period_year"))
    entry = lambda c: F.struct(c["y"].alias("y"), c["pos"].alias("pos"), c["col"].alias("col"), c["value"].alias("value"))
    h = F.sort_array(F.transform(F.filter("cells", lambda c: c["year"] == F.col("period_year")), entry))
    a = a.select("slug", "kind", "key", "label", "period_year", h.alias("h")).where(F.array_min("h.value") != F.array_max("h.value"))
    at = F.transform("h", lambda x: F.struct((-x["y"]).alias("y"), (-x["pos"]).alias("pos"), (-x["col"]).alias("col"), x["value"].alias("value")))
    year = F.transform("h", lambda x: -x["y"])
    history = F.transform("h", lambda x: F.struct((-x["y"]).alias("report_year"), x["value"].alias("value")))
    return a.select("slug", "kind", "key", "label", "period_year", F.array_max(at)["value"].alias("used"), F.array_max(year).alias("used_report"), F.array_min(at)["value"].alias("original"), F.array_min(year).alias("original_report"), history.alias("history"))


def restatement_count(audit: DataFrame) -> DataFrame:
    return audit.groupBy("slug", "kind").agg(F.count("*").alias("n_restated"))
