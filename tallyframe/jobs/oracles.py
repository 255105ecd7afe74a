"""DuckDB SQL for the queries of this library."""

from __future__ import annotations

import re

from tallyframe.functions.labels import CURRENCY_SYMBOLS, KEY_REWRITES
from tallyframe.functions.pages import ANCHORS, DISQUALIFYING, ENDING_CASH, ENGLISH_WORDS, HEADINGS, KINDS, LANDMARKS
from tallyframe.functions.urls import FILING_RULES, STOP_WORDS
from tallyframe.jobs import derive, stored
from tallyframe.operators.checking import CHECKS, NET_PROFIT

_BOUNDS = {r"(?<![A-Za-z0-9_])": r"\b", r"(?![A-Za-z0-9_])": r"\b"}


def _re(pattern: str) -> str:
    for ours, theirs in _BOUNDS.items():
        pattern = pattern.replace(ours, theirs)
    return pattern.replace("'", "''")


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def canon(label: str) -> str:
    k = f"lower({label})"
    for pattern, to in KEY_REWRITES:
        k = f"regexp_replace({k}, '{_re(pattern)}', '{to.replace('$', chr(92))}', 'g')"
    one = "CASE WHEN w LIKE '%ss' THEN w WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%xes' THEN left(w, length(w) - 2) WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
    s = f"array_to_string(list_transform(string_split(trim({k}), ' '), lambda w: {one}), ' ')"
    return f"CASE {s} WHEN '' THEN lower(trim({label})) WHEN 'total revenue' THEN 'revenue' ELSE {s} END"


def shown(label: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({label}, '[\s,]*\([A-Za-z]?\.?\d+\)', '', 'g'), '([A-Za-z])\d+\b', '\1', 'g'), '\s{{2,}}', ' ', 'g'))"


def expense(label: str) -> str:
    low = f"lower({label})"
    return rf"(CASE WHEN {low} LIKE '%income%' AND {low} LIKE '%expense%' THEN false WHEN regexp_matches({low}, '\b(profit|loss|earnings|gross)\b') THEN false WHEN {low} LIKE '%income tax%' THEN true ELSE regexp_matches({low}, '\b(costs?|expenses?)\b') END)"


def _given(sql: str) -> str:
    for n in ("lineitem", "orders", "customer", "part", "documents", "pages", "facts"):
        sql = sql.replace("{%s}" % n, n)
    return sql


CELLS = f"""facts AS ({_given(derive.FACTS)}), cells AS ({_given(derive.CELLS)})"""
KEYED = rf"""{CELLS},
r0 AS (SELECT *, row_number() OVER (PARTITION BY slug, report_year, kind ORDER BY rank) - 1 AS pos, {canon('label')} AS base FROM (SELECT DISTINCT slug, report_year, kind, rank, label, row_kind FROM cells)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY slug, report_year, kind, base ORDER BY pos) AS nth,
  first_value(CASE WHEN row_kind IN ('total', 'subtotal') OR base = 'total' OR base LIKE 'total %' THEN base END IGNORE NULLS) OVER (PARTITION BY slug, report_year, kind ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tag FROM r0),
keyed AS (SELECT *, CASE WHEN kind = 'balance' THEN concat_ws('@@', base, tag) WHEN nth = 1 THEN base ELSE base || '#' || (nth - 1) END AS key FROM r1),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY slug, report_year, kind, key ORDER BY pos) = 1)"""
GRID = """cols AS (SELECT DISTINCT slug, report_year, kind, period_year FROM cells),
figures AS (SELECT f.slug, f.report_year, f.kind, f.pos, f.key, f.label, p.period_year, c.value FROM firsts f JOIN cols p USING (slug, report_year, kind)
  LEFT JOIN cells c ON c.slug = f.slug AND c.report_year = f.report_year AND c.kind = f.kind AND c.rank = f.rank AND c.label = f.label AND c.period_year = p.period_year)"""
COMPILED = rf"""{KEYED}, {GRID},
newest AS (SELECT slug, max(report_year) AS newest FROM cells GROUP BY slug),
t0 AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY slug, kind, key ORDER BY report_year DESC, pos) = 1),
t1 AS (SELECT t0.*, row_number() OVER (PARTITION BY slug, kind ORDER BY report_year DESC, pos) - 1 AS ord, row_kind <> 'section' AND report_year < newest AS historical FROM t0 JOIN newest USING (slug)),
v AS (SELECT slug, kind, key, period_year, arg_max(value, report_year) AS value, min(value) <> max(value) AS differs, min(-abs(value)) <> max(-abs(value)) AS differs_as_cost FROM figures WHERE value IS NOT NULL GROUP BY ALL),
years AS (SELECT DISTINCT slug, kind, period_year FROM cells),
c0 AS (SELECT t1.slug, t1.kind, t1.ord, t1.key, t1.label AS raw, {shown('t1.label')} AS label, t1.row_kind, years.period_year, v.value, differs, differs_as_cost, historical
  FROM t1 JOIN years USING (slug, kind) LEFT JOIN v ON v.slug = t1.slug AND v.kind = t1.kind AND v.key = t1.key AND v.period_year = years.period_year),
compiled AS (SELECT slug, kind, ord, key, label, row_kind, period_year, CASE WHEN kind = 'income' AND value > 0 AND {expense('label')} THEN -value ELSE value END AS value,
  coalesce(CASE WHEN kind = 'income' AND {expense('raw')} THEN differs_as_cost ELSE differs END, false) AS restated, historical FROM c0)"""


def _found(kind: str, match: str) -> str:
    return f"(min({{'ord': ord, 'value': value}}) FILTER (kind = '{kind}' AND value IS NOT NULL AND ({match}))).value"


ISSUES = rf"""{COMPILED},
rowless AS (SELECT y.slug, y.kind, y.period_year FROM years y ANTI JOIN compiled c ON c.slug = y.slug AND c.kind = y.kind AND c.period_year = y.period_year),
low AS (SELECT slug, kind, ord, label, period_year, value, lower(trim(label)) AS l FROM compiled UNION ALL SELECT slug, kind, NULL, NULL, period_year, NULL, NULL FROM rowless),
h AS (SELECT slug, period_year, {_found('balance', "l = 'total assets'")} AS assets, {_found('balance', "l IN ('total equity and liabilities', 'total liabilities and equity')")} AS both0, {_found('balance', "l = 'total equity'")} AS equity, {_found('balance', "l = 'total liabilities'")} AS liab,
  {_found('income', 'l IN ' + _list(NET_PROFIT))} AS profit, {_found('cashflow', 'l IN ' + _list(NET_PROFIT))} AS cash_profit, {_found('balance', "contains(l, 'cash and cash equivalents') OR contains(l, 'cash at bank') OR l = 'cash'")} AS cash, {_found('cashflow', "contains(l, 'cash') AND contains(l, 'end')")} AS ending,
  {_found('income', "regexp_matches(l, 'revenue|sales|turnover|total operating performance')")} AS revenue, {_found('cashflow', "contains(l, 'operating activities')")} AS operating, bool_or(kind = 'income') AS hi, bool_or(kind = 'balance') AS hb, bool_or(kind = 'cashflow') AS hc FROM low GROUP BY slug, period_year),
e AS (SELECT *, coalesce(both0, equity + liab) AS both1 FROM h),
issues AS (
  SELECT slug, '{CHECKS["balance"]}' AS "check", 'fail' AS severity, period_year, both1 AS expected, assets AS actual FROM e WHERE abs(assets - both1) > greatest(1, abs(both1) * 0.005)
  UNION ALL SELECT slug, '{CHECKS["profit"]}', 'fail', period_year, profit, cash_profit FROM e WHERE hi AND abs(profit - cash_profit) > greatest(1, abs(cash_profit) * 0.005)
  UNION ALL SELECT slug, '{CHECKS["cash"]}', 'warning', period_year, cash, ending FROM e WHERE hb AND abs(cash - ending) > greatest(1, abs(ending) * 0.005)
  UNION ALL SELECT slug, '{CHECKS["no_income"]}', 'fail', period_year, 0, 0 FROM e WHERE hi AND revenue IS NULL
  UNION ALL SELECT slug, '{CHECKS["no_balance"]}', 'fail', period_year, 0, 0 FROM e WHERE hb AND assets IS NULL
  UNION ALL SELECT slug, '{CHECKS["no_cashflow"]}', 'fail', period_year, 0, 0 FROM e WHERE hc AND operating IS NULL)"""
#: The same where some companies' cash-flow statements have periods but no rows, and where balance sheets were cut off.
ROWLESS = ISSUES.replace("label, row_kind FROM cells)", "label, row_kind FROM cells WHERE NOT (kind = 'cashflow' AND slug LIKE '%7'))")
CUT_OFF = ISSUES.replace(CELLS, CELLS.replace("cells AS (", "cells0 AS (") + ", cells AS (SELECT * FROM cells0 WHERE NOT (kind = 'balance' AND slug LIKE '%3'))")
AUDIT = rf"""{KEYED}, {GRID.replace('FROM firsts f', 'FROM keyed f')},
n0 AS (SELECT *, CASE WHEN value > 0 AND {expense('label')} THEN -value ELSE value END AS v FROM figures),
names AS (SELECT slug, kind, key, arg_max(label, report_year * 1000 - pos) AS label FROM n0 GROUP BY ALL),
a AS (SELECT slug, kind, key, period_year, arg_max(v, report_year) AS used, max(report_year) AS used_report, arg_min(v, report_year) AS original, min(report_year) AS original_report,
  string_agg(report_year || ':' || CAST(v AS DECIMAL(18,2)), ', ' ORDER BY report_year DESC) AS history FROM n0 WHERE v IS NOT NULL GROUP BY ALL HAVING min(v) <> max(v))"""

BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STRIP = f"'^{BLANK}+|{BLANK}+$', '', 'g'"
PAGES = f"pages0 AS ({_given(derive.PAGES.replace('{numbered}', derive.NUMBERED))})"
SEGS = rf"""seg AS (SELECT slug, report_year, page_index, n, regexp_replace(s, {STRIP}) AS seg FROM (SELECT slug, report_year, page_index, unnest(list) AS s, generate_subscripts(list, 1) AS n
  FROM (SELECT *, string_split_regex(text, '[\n\r]| {{2,}}| › |\|') AS list FROM pages0)))"""


def _boilerplate(share: float) -> str:
    return f"""total AS (SELECT slug, report_year, count(*) AS total FROM pages0 GROUP BY ALL),
boiler AS (SELECT b.slug, b.report_year, b.seg, b.n_pages FROM (SELECT slug, report_year, seg, count(DISTINCT page_index) AS n_pages FROM seg WHERE length(seg) >= 4 GROUP BY ALL) b JOIN total USING (slug, report_year) WHERE n_pages > total * {share})"""


CLEANED = f"""{PAGES}, {SEGS}, {_boilerplate(0.25)},
cleaned AS (SELECT p.slug, p.report_year, p.page_index, coalesce(c.text, '') AS text FROM pages0 p LEFT JOIN (SELECT slug, report_year, page_index, string_agg(seg, ' ' ORDER BY n) AS text FROM seg ANTI JOIN boiler USING (slug, report_year, seg) GROUP BY ALL) c USING (slug, report_year, page_index))"""
HEADS = rf"""headings AS (SELECT slug, report_year, page_index, left(flat, 110) AS head FROM (SELECT *, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), {STRIP}) AS flat FROM cleaned) WHERE {' OR '.join(f"contains(lower(flat), '{m}')" for m in LANDMARKS)})"""


def _score(kind: str) -> str:
    parts = [f"CASE WHEN contains(low, '{h}') THEN 5 ELSE 0 END" for h in HEADINGS[kind]] + [f"CASE WHEN regexp_matches(low, '(?s){a}.{{0,38}}[0-9]{{2}}') THEN 1 ELSE 0 END" for a in ANCHORS[kind]]
    return f"CASE WHEN {' OR '.join(f"contains(low, '{m}')" for m in DISQUALIFYING)} THEN 0 ELSE {' + '.join(parts)} END"


CANDIDATES = f"""lowp AS (SELECT slug, report_year, page_index, lower(text) AS low FROM pages0),
scored AS ({' UNION ALL '.join(f"SELECT slug, report_year, '{k}' AS kind, page_index, {_score(k)} AS score FROM lowp" for k in KINDS)}),
candidates AS (SELECT *, row_number() OVER (PARTITION BY slug, report_year, kind ORDER BY score DESC, page_index) AS rank FROM scored WHERE score >= 3 QUALIFY rank <= 3)"""
_any = lambda names: "(" + " OR ".join(f"contains(low, '{n}')" for n in names) + ")"
_others = {k: [h for o in KINDS if o != k for h in HEADINGS[o]] + ["comprehensive income", "changes in equity"] for k in KINDS}
PICKS = f"""{CLEANED}, {HEADS}, {CANDIDATES},
ranked AS (SELECT slug, report_year, kind, page_index, 2 AS place FROM candidates WHERE rank = 1
  UNION ALL SELECT slug, report_year, 'income', page_index, 1 FROM headings WHERE page_index = 9
  UNION ALL SELECT slug, report_year, 'balance', page_index, 0 FROM pages0 WHERE page_index = 5 AND slug LIKE '%3'),
p0 AS (SELECT slug, report_year, kind, page_index FROM ranked QUALIFY row_number() OVER (PARTITION BY slug, report_year, kind ORDER BY place, page_index) = 1),
hits AS (SELECT slug, report_year, 'balance' AS kind, page_index FROM lowp WHERE contains(low, 'total assets') AND ({_any(['total equity and liabilities', 'total liabilities and equity', 'total liabilities and shareholders'])} OR contains(low, 'total equity') AND contains(low, 'total liabilities'))
    AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.slug = lowp.slug AND r.report_year = lowp.report_year AND r.kind = 'balance' AND place = 0)
  UNION ALL SELECT slug, report_year, 'cashflow', page_index FROM lowp WHERE contains(low, 'operating activities') AND contains(low, 'investing activities') AND contains(low, 'financing activities') AND {_any(ENDING_CASH)}),
near AS (SELECT h.slug, h.report_year, h.kind, h.page_index AS snapped FROM hits h LEFT JOIN p0 i ON i.slug = h.slug AND i.report_year = h.report_year AND i.kind = 'income'
  QUALIFY row_number() OVER (PARTITION BY h.slug, h.report_year, h.kind ORDER BY coalesce(abs(h.page_index - i.page_index), 0), h.page_index) = 1),
picks AS (SELECT slug, report_year, kind, coalesce(snapped, page_index) AS page_index FROM p0 FULL JOIN near USING (slug, report_year, kind))"""
_SPANS = f"""
beside AS (SELECT p.slug, p.report_year, p.kind, p.page_index AS pick, p.page_index + d AS page_index, CASE kind WHEN 'income' THEN 0 WHEN 'balance' THEN 1 ELSE 2 END AS place FROM picks p, (VALUES (-1), (1)) AS x(d)),
spans AS (SELECT slug, report_year, kind, page_index FROM (SELECT b.* FROM beside b JOIN (SELECT *, lower(text) AS low FROM cleaned) c USING (slug, report_year, page_index) ANTI JOIN picks q ON q.slug = b.slug AND q.report_year = b.report_year AND q.page_index = b.page_index
  WHERE NOT CASE kind {' '.join(f"WHEN '{k}' THEN {_any(_others[k])}" for k in KINDS)} END) QUALIFY row_number() OVER (PARTITION BY slug, report_year, page_index ORDER BY pick, place) = 1
  UNION ALL SELECT slug, report_year, kind, page_index FROM picks)"""
SPANS = f"{PICKS},{_SPANS}"
#: The same without hints, over English reports only.
_ENGLISH = f"""w AS (SELECT slug, report_year, regexp_extract_all(lower(text), '[a-z]+') AS w FROM pages1 WHERE page_index < 30),
bad AS (SELECT slug, report_year FROM w GROUP BY ALL HAVING NOT (sum(len(w)) < 200 OR sum(len(list_filter(w, lambda x: x IN {_list(ENGLISH_WORDS)}))) / sum(len(w)) > 0.15)),
pages0 AS (SELECT * FROM pages1 ANTI JOIN bad USING (slug, report_year))"""
PLAIN_SPANS = re.sub(r"  UNION ALL SELECT slug, report_year, '(income|balance)', page_index, [01] FROM (headings|pages0) WHERE[^\n]*?(?=\)?,?\n)", "", SPANS.replace(PAGES, PAGES.replace("pages0 AS", "pages1 AS", 1) + ", " + _ENGLISH))

_decode = "CASE WHEN regexp_matches({0}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN {0} ELSE url_decode({0}) END"


def _title(url: str) -> str:
    last = f"string_split(string_split({url}, '?')[1], '/')[-1]"
    return f"CASE WHEN regexp_matches({last}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN {url} ELSE url_decode({last}) END"


def _year(title: str) -> str:
    return rf"coalesce(TRY_CAST(nullif(regexp_extract({title}, '(?:19|20)[0-9]{{2}}'), '') AS INT), 2000 + TRY_CAST(nullif(regexp_extract(lower({title}), 'ar[-_]?([0-9]{{2}})\b', 1), '') AS INT))"


def _type(url: str) -> str:
    low = f"lower({_decode.format(url)})"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{_re(p)}') THEN '{n}'" for n, p in FILING_RULES) + " ELSE 'Other' END"


CATALOG = f"""links AS ({_given(derive.FILING_LINKS)}),
d0 AS (SELECT slug, CAST(page_ord % 20 + 2000 AS INT) AS year, CASE WHEN page_ord % 24 = 11 THEN 'https://other.test/f' || page_ord ELSE href END AS url FROM links WHERE page_ord % 12 IN (0, 1) OR page_ord % 24 = 11),
disc AS (SELECT slug, year, min(url) AS url FROM d0 GROUP BY ALL),
seen AS (SELECT slug, href AS url, min(page_ord) AS place FROM links WHERE slug NOT LIKE 'm.%' AND regexp_matches(href, '(?i)\\.pdf(\\?|#|$)') AND contains(lower(regexp_extract(href, '://([^/?#]*)', 1)), slug) GROUP BY ALL),
more AS (SELECT slug, url, min(year) AS key_year FROM disc WHERE slug NOT LIKE 'm.%' GROUP BY ALL HAVING (slug, url) NOT IN (SELECT (slug, url) FROM seen)),
every AS (SELECT slug, url, {_title('url')} AS title, {_type('url')} AS type, {_year(_title('url'))} AS year, false AS used, 0 AS part, place FROM seen
  UNION ALL SELECT slug, url, {_title('url')}, {_type('url')}, coalesce({_year(_title('url'))}, nullif(key_year, 0)), true, 1, 0 FROM more),
catalog AS (SELECT slug, year, type, title, url, used, row_number() OVER (PARTITION BY slug ORDER BY coalesce(year, 0) DESC, lower(type), part, place, url) - 1 AS ord FROM every),
chosen AS (SELECT slug, year, url FROM catalog WHERE year <> 0 AND type IN ('Annual Report', 'Financial Statements') QUALIFY row_number() OVER (PARTITION BY slug, year ORDER BY type, ord) = 1),
marked AS (SELECT c.* REPLACE (c.used OR EXISTS (SELECT 1 FROM disc d WHERE d.slug = c.slug AND d.url = c.url) AS used) FROM catalog c)"""

SHELF = f"""shelf AS (SELECT page_id, host, n, CASE WHEN starts_with(href, '/') THEN 'https://' || host || href ELSE href END AS url, trim(replace(replace(text, '<b>', ''), '</b>', '')) AS t
  FROM ({_given(derive.SHELF.replace("{hosts}", f"(SELECT * FROM {derive.HOSTS} AS h WHERE host <> '') AS h").replace("{numbers}", "(SELECT CAST(range AS INT) AS n FROM range(280)) AS r"))}))"""
HTML_CATALOG = f"""disc AS (SELECT host AS slug, 2003 AS year, 'https://' || host || '/docs/annual-report-2003.pdf' AS url FROM shelf WHERE page_id % 5 = 0 GROUP BY ALL),
seen AS (SELECT host AS slug, url, min(page_id * 1000 + n) AS place FROM shelf WHERE regexp_matches(url, '(?i)\\.pdf(\\?|#|$)') GROUP BY ALL),
every AS (SELECT slug, url, {_title('url')} AS title, {_type('url')} AS type, {_year(_title('url'))} AS year, false AS used, 0 AS part, place FROM seen
  UNION ALL SELECT slug, url, {_title('url')}, {_type('url')}, coalesce({_year(_title('url'))}, year), true, 1, 0 FROM disc WHERE (slug, url) NOT IN (SELECT (slug, url) FROM seen)),
catalog AS (SELECT slug, year, type, title, url, used, row_number() OVER (PARTITION BY slug ORDER BY coalesce(year, 0) DESC, lower(type), part, place, url) - 1 AS ord FROM every),
chosen AS (SELECT slug, year, url FROM catalog WHERE year <> 0 AND type IN ('Annual Report', 'Financial Statements') QUALIFY row_number() OVER (PARTITION BY slug, year ORDER BY type, ord) = 1),
filled AS (SELECT * FROM disc UNION ALL SELECT * FROM chosen ANTI JOIN disc USING (slug, year))"""

_LABEL = """CASE p_partkey % 8 WHEN 0 THEN n || ' expenses (D.2)' WHEN 1 THEN 'Increase/decrease in ' || n || 's' WHEN 2 THEN n || '1 for the year' WHEN 3 THEN 'Net cash generated from ' || n
  WHEN 4 THEN 'Profit (loss) on ' || n || ', (b.3)' WHEN 5 THEN 'Income taxes  of ' || n WHEN 6 THEN 'Total Revenues' ELSE n || ' Income and expenses' END"""
REPLIES = """rep AS (SELECT o_orderkey AS n, CAST(CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS v, o_orderkey % 11 = 0 AS bad, o_orderkey % 5 = 0 AS short FROM orders),
parsed AS (SELECT 'r' || n AS slug, CASE WHEN bad THEN '' ELSE '2020,2019' END AS periods,
  CASE WHEN bad THEN '' ELSE 'Revenue:line:' || v || ',' || CASE WHEN short OR n % 7 = 0 THEN '-' ELSE CAST(n AS VARCHAR) END || ';Assets:section:;Tax:total:-,2' END AS figures, CASE WHEN bad THEN 0 ELSE 1 + CAST(short AS INT) END AS n_mismatched FROM rep)"""

_symbol = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{CURRENCY_SYMBOLS.get(c, c)}'" for i, c in enumerate(("EUR", "DKK", "USD", "GBP", "CHF", "SEK"))) + " END"

SQL: dict[str, str] = {
    "label_keys": f"WITH p AS (SELECT p_partkey, p_retailprice AS v, {_LABEL} AS label FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS n FROM part)) SELECT p_partkey, {canon('label')} AS key, {shown('label')} AS shown, {expense('label')} AS expense, CASE WHEN v > 0 AND {expense('label')} THEN -v ELSE v END AS value FROM p",
    "row_keys": f"WITH {KEYED} SELECT slug, report_year, kind, pos, key, label, row_kind FROM keyed",
    "statement_cells": f"WITH {KEYED}, {GRID} SELECT slug, report_year, kind, pos, key, period_year, value FROM figures",
    "compiled": f"WITH {COMPILED} SELECT * FROM compiled",
    "newest_periods": f"""WITH {COMPILED}, l AS (SELECT *, dense_rank() OVER (PARTITION BY slug, kind ORDER BY period_year DESC) AS n FROM compiled QUALIFY n <= 3)
SELECT slug, kind, ord, key, historical, string_agg(CAST(period_year AS VARCHAR), ',' ORDER BY n) AS periods, string_agg(coalesce(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY n) AS figures, coalesce(string_agg(CASE WHEN restated THEN CAST(n - 1 AS VARCHAR) END, ',' ORDER BY n), '') AS restated_at FROM l GROUP BY ALL""",
    "statement_shape": f"WITH {COMPILED} SELECT slug, kind, count(DISTINCT period_year) AS n_periods, count(DISTINCT ord) AS n_rows FROM compiled GROUP BY ALL",
    "validation_issues": f'WITH {ROWLESS} SELECT slug, "check", severity, period_year, CAST(floor(expected) AS BIGINT) AS expected, CAST(floor(actual) AS BIGINT) AS actual FROM issues',
    "replies_to_statements": f"WITH {CUT_OFF}, s AS (SELECT slug, CASE WHEN bool_or(severity = 'fail') THEN 'fail' WHEN count(severity) > 0 THEN 'warning' ELSE 'pass' END AS status FROM (SELECT DISTINCT slug FROM cells0) LEFT JOIN issues USING (slug) GROUP BY slug) SELECT slug, status, kind, ord, label, period_year, value, restated, historical FROM compiled JOIN s USING (slug)",
    "validation_status": f"WITH {ROWLESS} SELECT slug, CASE WHEN bool_or(severity = 'fail') THEN 'fail' WHEN count(severity) > 0 THEN 'warning' ELSE 'pass' END AS status FROM (SELECT DISTINCT slug FROM cells) LEFT JOIN issues USING (slug) GROUP BY slug",
    "subtotal_notes": f"""WITH {COMPILED}, b AS (SELECT *, coalesce(sum(CASE WHEN row_kind <> 'line' THEN 1 ELSE 0 END) OVER (PARTITION BY slug, kind, period_year ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM compiled),
s AS (SELECT slug, kind, period_year, block, sum(CASE WHEN row_kind = 'line' THEN coalesce(value, 0) ELSE 0 END) AS line_sum FROM b GROUP BY ALL)
SELECT b.slug, b.kind, b.ord, b.label, b.period_year, CAST(floor(line_sum + 0.0003) AS BIGINT) AS line_sum, CAST(floor(value + 0.0003) AS BIGINT) AS reported FROM b JOIN s USING (slug, kind, period_year, block) WHERE row_kind IN ('subtotal', 'total') AND abs(line_sum - value) > 1""",
    "restatement_audit": f"WITH {AUDIT} SELECT a.slug, a.kind, a.key, label, period_year, used, used_report, original, original_report, history FROM a JOIN names USING (slug, kind, key)",
    "restatement_count": f"WITH {AUDIT} SELECT slug, kind, count(*) AS n_restated FROM a GROUP BY ALL",
    "shown_figures": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '—' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN length(sym) > 1 THEN sym || ' ' ELSE sym END || format('{{:,}}', CAST(round(o_totalprice) AS BIGINT)) END AS shown
FROM orders JOIN (SELECT c_custkey, {_symbol} AS sym FROM customer) c ON o_custkey = c_custkey""",
    "english_reports": f"""WITH {PAGES}, w AS (SELECT slug, report_year, regexp_extract_all(lower(text), '[a-z]+') AS w FROM pages0 WHERE page_index < 30)
SELECT slug, report_year, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_filter(w, lambda x: x IN {_list(ENGLISH_WORDS)}))) AS BIGINT) AS hits, sum(len(w)) < 200 OR sum(len(list_filter(w, lambda x: x IN {_list(ENGLISH_WORDS)}))) / sum(len(w)) > 0.05 AS english FROM w GROUP BY ALL""",
    "english_pages": f"""WITH {PAGES}, w AS (SELECT slug, report_year, regexp_extract_all(lower(text), '[a-z]+') AS w FROM pages0 WHERE page_index < 30),
bad AS (SELECT slug, report_year FROM w GROUP BY ALL HAVING NOT (sum(len(w)) < 200 OR sum(len(list_filter(w, lambda x: x IN {_list(ENGLISH_WORDS)}))) / sum(len(w)) > 0.15))
SELECT slug, report_year, count(*) AS n_pages FROM pages0 ANTI JOIN bad USING (slug, report_year) GROUP BY ALL""",
    "boilerplate": f"WITH {PAGES}, {SEGS}, {_boilerplate(0.05)} SELECT * FROM boiler",
    "cleaned_pages": f"WITH {CLEANED} SELECT slug, report_year, page_index, md5(text) AS digest, length(text) AS chars FROM cleaned",
    "heading_map": f"WITH {CLEANED}, {HEADS} SELECT * FROM headings",
    "candidate_pages": f"WITH {PAGES}, {CANDIDATES} SELECT * FROM candidates",
    "candidate_union": f"WITH {PAGES}, {CANDIDATES} SELECT DISTINCT slug, report_year, page_index FROM candidates",
    "statement_picks": f"WITH {PICKS} SELECT * FROM picks",
    "statement_spans": f"WITH {SPANS} SELECT * FROM spans",
    "statement_text": f"WITH {SPANS}, x AS (SELECT slug, report_year, kind, left(string_agg(text, chr(10) ORDER BY page_index), 12000) AS text FROM spans JOIN pages0 USING (slug, report_year, page_index) GROUP BY ALL) SELECT slug, report_year, kind, md5(text) AS digest, length(text) AS chars FROM x",
    "pages_to_text": f"WITH {PLAIN_SPANS}, x AS (SELECT slug, report_year, kind, left(string_agg(text, chr(10) ORDER BY page_index), 12000) AS text FROM spans JOIN pages0 USING (slug, report_year, page_index) GROUP BY ALL) SELECT slug, report_year, kind, md5(text) AS digest, length(text) AS chars FROM x",
    "page_overrides": """SELECT o_orderkey, 'income' AS kind, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 300 AS INT) ELSE 7 END AS page_index FROM orders
UNION ALL SELECT o_orderkey, 'balance', CAST(o_orderkey % 299 AS INT) FROM orders UNION ALL SELECT o_orderkey, 'cashflow', CAST(o_orderkey % 50 AS INT) FROM orders WHERE o_orderkey % 4 <> 0""",
    "parsed_replies": f"WITH {REPLIES} SELECT * FROM parsed",
    "reply_quality": f"WITH {REPLIES} SELECT slug, 2020 AS report_year, 'income' AS kind, n_mismatched FROM parsed",
    "page_links": rf"""WITH a AS (SELECT page_id, url, unnest(list) AS a, generate_subscripts(list, 1) - 1 AS ord FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a[^>]+href="[^"]+"[^>]*>.*?</a>') AS list FROM pages)),
b AS (SELECT page_id, url, ord, left(regexp_replace(regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g'), '{BLANK}+', ' ', 'g'), {STRIP}), 100) AS text,
  regexp_extract(url, '^[a-z]+://[^/?#]*') || url_encode_path AS href FROM (SELECT *, array_to_string(list_transform(string_split(regexp_extract(a, '(?is)href="([^"]+)"', 1), '/'), lambda p: url_encode(p)), '/') AS url_encode_path FROM a)),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY page_id, url, href ORDER BY ord) = 1)
SELECT page_id, url, ord, text, replace(href, '%2C', ',') AS href FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY ord) <= 200""",
    "shelf_links": f"WITH {SHELF}, f AS (SELECT * FROM shelf QUALIFY row_number() OVER (PARTITION BY page_id, host, url ORDER BY n) = 1) SELECT host AS slug, page_id AS page_ord, n AS ord, t AS text, url AS href FROM f WHERE t <> '' OR contains(url, '.pdf') QUALIFY row_number() OVER (PARTITION BY page_id, host ORDER BY n) <= 200",
    "html_to_catalog": f"WITH {SHELF}, {HTML_CATALOG} SELECT slug, year, type, title, url, used OR url IN (SELECT url FROM filled f WHERE f.slug = catalog.slug) AS used, ord FROM catalog",
    "page_titles": rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '{BLANK}+', ' ', 'g'), {STRIP}) AS title FROM pages""",
    "pdf_links": f"WITH links AS ({_given(derive.FILING_LINKS)}) SELECT * FROM links WHERE ends_with(string_split(lower(href), '?')[1], '.pdf')",
    "official_pdfs": f"""WITH links AS ({_given(derive.FILING_LINKS)}), w AS (SELECT *, CASE WHEN length(slug) % 2 = 0 THEN regexp_extract(slug, '([a-z]+)', 1) ELSE 'nordic' END AS word FROM links)
SELECT slug, page_ord, href FROM w WHERE ends_with(string_split(lower(href), '?')[1], '.pdf') AND length(word) >= 3 AND (word NOT IN {_list(STOP_WORDS)}) AND contains(regexp_replace(slug, '^www\\.', ''), word)""",
    "company_slugs": rf"""SELECT c_custkey, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(string_split(lower(n), ' ')[1], '[^a-z0-9]', '', 'g') AS short,
  array_to_string(list_filter(list_concat([array_to_string(w, '')], w), lambda t: length(t) >= 3), ',') AS tokens
FROM (SELECT *, list_filter(string_split_regex(regexp_replace(lower(n), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) >= 2 AND t NOT IN {_list(STOP_WORDS)}) AS w FROM (SELECT c_custkey, c_mktsegment || ' & ' || c_name || ' Group plc.' AS n FROM customer))""",
    "search_results": """SELECT page_id, CAST(k AS INT) AS ord, CASE WHEN k = 5 THEN 'Plain' ELSE 'Annual report ' || page_id END AS title, CASE WHEN k = 5 THEN url ELSE 'https://firm.test/ir/' || page_id END AS url FROM pages, range(8) AS r(k)""",
    "filing_catalog": f"WITH {CATALOG} SELECT * FROM catalog",
    "report_urls": f"WITH {CATALOG} SELECT * FROM chosen",
    "discovered_filled": f"WITH {CATALOG} SELECT * FROM disc UNION ALL SELECT * FROM chosen ANTI JOIN disc USING (slug, year)",
    "filings_marked": f"WITH {CATALOG} SELECT slug, url, used FROM marked",
    "filings_by_type": f"WITH {CATALOG} SELECT slug, coalesce(type, 'All') AS type, count(*) AS n, CAST(sum(CAST(used AS INT)) AS BIGINT) AS n_used FROM marked GROUP BY GROUPING SETS ((slug, type), (slug))",
    "catalog_merged": f"WITH {CATALOG} SELECT slug, url, CASE WHEN slug LIKE '%a%' THEN title ELSE 'old ' || title END AS title FROM catalog",
    "source_list": f"WITH {CELLS} SELECT slug, report_year, CASE WHEN report_year % 3 = 0 THEN 'https://r.test/' || slug WHEN report_year % 2 = 0 THEN 'https://d.test/' || slug || '/' || report_year ELSE '' END AS url FROM (SELECT DISTINCT slug, report_year FROM cells)",
    "pending_reports": f"WITH {CELLS} SELECT DISTINCT slug, report_year FROM cells WHERE report_year BETWEEN 1999 AND 2000",
    "recompiled": f"WITH {COMPILED} SELECT slug, kind, key, period_year, value, restated, historical FROM compiled WHERE slug IN (SELECT slug FROM cells WHERE report_year >= 2002)",
}

_NATION = stored.NATION_CELLS.replace("{orders}", "orders").replace("{customer}", "customer").replace("{nation}", "nation")


def _nation(name: str, where: str) -> str:
    """Tables <name>_cells, <name>_grid (compiled) and <name>_status of the nations' reports that `where` selects."""
    return f"""{name}_cells AS (SELECT * FROM nations WHERE {where}),
{name}_per AS (SELECT slug, label, period_year, arg_max(value, report_year) AS value, min(value) <> max(value) AS restated FROM {name}_cells GROUP BY ALL),
{name}_last AS (SELECT slug, label, last < max(last) OVER (PARTITION BY slug) AS historical FROM (SELECT slug, label, max(report_year) AS last FROM {name}_cells GROUP BY ALL)),
{name}_grid AS (SELECT slug, lower(label) AS key, label, period_year, value, coalesce(restated, false) AS restated, historical FROM {name}_last JOIN (SELECT DISTINCT slug, period_year FROM {name}_cells) USING (slug) LEFT JOIN {name}_per USING (slug, label, period_year)),
{name}_status AS (SELECT slug, CASE WHEN bool_or(label = 'Revenue') THEN 'pass' ELSE 'fail' END AS status, count(DISTINCT period_year) AS years, count(DISTINCT report_year) AS reports FROM {name}_cells GROUP BY slug)"""


_TWO = f"nations AS ({_NATION}), {_nation('first', f'report_year <= {stored.FIRST}')}, {_nation('later', "slug < 'nation_2'")}"
_ALL = f"nations AS ({_NATION}), {_nation('every', 'true')}"
_GROUPED = """rows0 AS (SELECT slug, report_year, kind, rank, label, row_kind, row_number() OVER (PARTITION BY slug, report_year, kind ORDER BY rank, label, row_kind) - 1 AS pos FROM (SELECT DISTINCT slug, report_year, kind, rank, label, row_kind FROM {0})),
cols0 AS (SELECT DISTINCT slug, report_year, kind, period_year FROM {0}),
shown0 AS (SELECT r.slug, r.report_year, r.kind, string_agg('12/31/' || p.period_year, ',' ORDER BY p.period_year DESC) AS periods, CAST(r.pos AS INTEGER) AS pos, r.label, string_agg(coalesce(CAST(CAST(floor(c.value) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY p.period_year DESC) AS figures
  FROM rows0 r JOIN cols0 p USING (slug, report_year, kind) LEFT JOIN {0} c ON c.slug = r.slug AND c.report_year = r.report_year AND c.kind = r.kind AND c.rank = r.rank AND c.label = r.label AND c.period_year = p.period_year GROUP BY ALL),
every_kind AS (SELECT * FROM (SELECT DISTINCT slug, report_year FROM {0}) CROSS JOIN (VALUES ('income'), ('balance'), ('cashflow')) AS k(kind)),
read0 AS (SELECT e.slug, e.report_year, e.kind, coalesce(periods, '') AS periods, coalesce(pos, -1) AS pos, label, coalesce(figures, CASE WHEN pos IS NOT NULL THEN '' END) AS figures FROM every_kind e LEFT JOIN shown0 USING (slug, report_year, kind))"""
_LINKED = f"links AS ({_given(derive.FILING_LINKS)})"
_FILED = f"""{_LINKED}, seen AS (SELECT DISTINCT slug, href AS url FROM links WHERE regexp_matches(href, '(?i)\\.pdf(\\?|#|$)') AND contains(lower(regexp_extract(href, '://([^/?#]*)', 1)), slug)), filed AS (SELECT slug, url, {_title('url')} AS title, {_type('url')} AS type FROM seen)"""

SQL |= {
    "pages_read": f"WITH {PAGES} SELECT slug, report_year, page_index, md5(text) AS digest, length(text) AS chars FROM pages0",
    "reports_read": f"WITH nations AS ({_NATION}), {_GROUPED.format('nations')} SELECT * FROM read0",
    "reports_unpivoted": f"WITH {CELLS}, {_GROUPED.format('cells')} SELECT * FROM read0",
    "discovered_read": f"WITH {_LINKED} SELECT slug, CAST(page_ord % 20 + 2000 AS INTEGER) AS year, min(href) AS url FROM links GROUP BY ALL",
    "catalog_published": f"WITH {_FILED} SELECT slug, url, CASE WHEN slug LIKE '%a%' THEN 'new ' ELSE '' END || title AS title FROM filed",
    "filings_filtered": f"WITH {_FILED} SELECT slug, url, type FROM filed WHERE type = 'Annual Report'",
    "statements_published": f"""WITH {_TWO}, x AS (SELECT g.slug, s.status, g.key, s.reports, g.period_year, g.value FROM later_grid g JOIN later_status s USING (slug) WHERE s.status = 'pass'
UNION ALL SELECT g.slug, s.status, g.key, s.reports, g.period_year, g.value FROM first_grid g JOIN first_status s USING (slug) WHERE g.slug NOT IN (SELECT slug FROM later_status WHERE status = 'pass')) SELECT slug, status, key, CAST(reports AS INTEGER) AS n_sources, period_year, value FROM x""",
    "validation_published": f"""WITH {_TWO}, x AS (SELECT * FROM later_status UNION ALL SELECT * FROM first_status ANTI JOIN later_status USING (slug)) SELECT slug, status, CAST(CASE WHEN status = 'fail' THEN years ELSE 0 END AS INTEGER) AS n_issues FROM x""",
    "one_company": f"WITH {_ALL} SELECT slug, key, period_year, value, restated, historical FROM every_grid WHERE slug = 'nation_7'",
    "display_places": f"WITH {COMPILED} SELECT slug, kind, key, historical, CAST(row_number() OVER (PARTITION BY slug, kind ORDER BY historical, ord) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT slug, kind, key, historical, ord FROM compiled)",
    "refreshed": f"WITH {_ALL} SELECT slug, key, period_year, value, restated, historical FROM every_grid",
}

#: Columns that are INT in Spark, where DuckDB counts and measures in BIGINT.
INTS = {
    "row_keys": "pos", "statement_cells": "pos", "compiled": "ord", "newest_periods": "ord", "subtotal_notes": "ord", "cleaned_pages": "chars", "candidate_pages": "rank", "statement_text": "chars", "pages_to_text": "chars", "replies_to_statements": "ord", "html_to_catalog": "ord", "page_links": "ord",
    "filing_catalog": "ord",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {name: f"SELECT * REPLACE (CAST({column} AS INTEGER) AS {column}) FROM ({SQL[name]})" for name, column in INTS.items()}
