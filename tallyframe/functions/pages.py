"""What the text of a report's page shows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.labels import BLANK, strip

KINDS = ["income", "balance", "cashflow"]
#: Titles of the statements, and line items beside which a figure stands.
HEADINGS = {
    "income": ["income statement", "statement of operations", "statement of profit or loss", "profit and loss"],
    "balance": ["statement of financial position", "balance sheet"],
    "cashflow": ["statement of cash flows", "cash flow statement", "statements of cash flows"],
}
#: Titles of statements of no such kind.
OTHER_STATEMENTS = ["comprehensive income", "changes in equity"]
ANCHORS = {
    "income": ["net sales", "total revenue", "gross profit", "operating profit", "operating income", "profit before tax", "profit after tax", "net income", "cost of sales", "cost of revenue"],
    "balance": ["total assets", "total equity", "total liabilities", "total current assets", "total non-current assets"],
    "cashflow": ["operating activities", "investing activities", "financing activities", "net cash"],
}
#: Phrases of pages that aren't the group's statements.
DISQUALIFYING = [
    "separate financial statements", "parent company financial statements", "company financial statements", "stand-alone financial statements",
    "standalone financial statements", "individual financial statements", "unconsolidated financial statements", "significant accounting policies",
]
#: Phrases that make a page part of the heading map.
LANDMARKS = [
    "consolidated income statement", "consolidated statement of", "income statement", "balance sheet", "statement of financial position", "statement of cash flows",
    "cash flow statement", "statement of comprehensive income", "statement of changes in equity", "notes to the consolidated", "notes to the financial", "independent auditor", "statutory auditor",
]
#: The ways a cash-flow statement names its last line.
ENDING_CASH = ["cash and cash equivalents at the end", "cash and cash equivalents at end", "at the end of the period", "at the end of the year", "at end of"]
#: The last lines of a balance sheet, of which one stands for both of the two below.
BOTH_SIDES = ["total equity and liabilities", "total liabilities and equity", "total liabilities and shareholders"]
EITHER_SIDE = ["total equity", "total liabilities"]
#: The parts of a cash-flow statement.
ACTIVITIES = ["operating activities", "investing activities", "financing activities"]
#: Words frequent in English reports.
ENGLISH_WORDS = ["the", "and", "of", "to", "in", "for", "as", "are", "with", "that", "this", "total", "cash", "income", "assets", "from", "other"]

#: Fixed value: how far behind a line item its figure may begin, in characters.
FIGURE_WITHIN = 38
#: Between the phrases of a digest: wider than any figure may be away.
APART = "\n" * (FIGURE_WITHIN + 2)


def alternation(phrases: list[str], blank: str = " ") -> str:
    """A pattern of the longest of the phrases that begins at a place; common beginnings are compared once. blank: the
    pattern that a blank in a phrase stands for."""
    heads = sorted({p[:1] for p in phrases})
    ways = [(blank if h == " " else re.escape(h)) + alternation([p[1:] for p in phrases if p[:1] == h], blank) for h in heads if h]
    if not ways:
        return ""
    if "" in heads:
        return f"(?:{'|'.join(ways)})?"
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def said(low: Column, phrases: list[str], behind: str = "") -> Column:
    """A short text that contains those of the phrases that low contains, overlapping ones too, and no others, from one
    pass over low: at each place the longest that begins there, with what the pattern `behind` finds after it."""
    first = "".join(sorted({p[0] for p in phrases}))
    found = F.regexp_extract_all(low, F.lit(f"(?s)(?=[{first}])(?=({alternation(phrases)}{behind}))"), F.lit(1))
    return F.array_join(F.array_distinct(found), APART)


def digest(low: Column) -> Column:
    """A short text of which page_score, disqualified and the signatures are as of the page itself: each phrase that the
    page says, up to the nearest figure if one stands beside it."""
    phrases = [*DISQUALIFYING, *BOTH_SIDES, *EITHER_SIDE, *ACTIVITIES, *ENDING_CASH, *[p for k in KINDS for p in HEADINGS[k] + ANCHORS[k]]]
    return said(low, phrases, f"(?:.{{0,{FIGURE_WITHIN}}}?[0-9]{{2}})?")


def contains_any(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def contains_all(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [low.contains(p) for p in phrases])


def disqualified(low: Column) -> Column:
    return contains_any(low, DISQUALIFYING)


def page_score(low: Column, kind: str) -> Column:
    """5 for each title of the statement, 1 for each line item followed by a figure within 40 characters; 0 on pages
    that are disqualified. low: the page's text in lower case, or its digest."""
    titles = [F.when(low.contains(h), 5).otherwise(0) for h in HEADINGS[kind]]
    items = [F.when(low.contains(a) & low.rlike(rf"(?s)\Q{a}\E.{{0,{FIGURE_WITHIN}}}[0-9]{{2}}"), 1).otherwise(0) for a in ANCHORS[kind]]
    return F.when(disqualified(low), 0).otherwise(reduce(lambda a, b: a + b, titles + items))


def heading_of(text: Column) -> Column:
    """The first 110 characters of a page with a landmark phrase, blanks collapsed; else null."""
    flat = strip(F.regexp_replace(text, f"{BLANK}+", " "))
    return F.when(is_landmark(F.lower(text)), F.substring(flat, 1, 110))


def is_landmark(low: Column) -> Column:
    """Whether a page has a landmark phrase, whatever blanks stand between its words."""
    return low.rlike(alternation(LANDMARKS, f"{BLANK}+"))


def has_balance_signature(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("total assets") & (contains_any(low, BOTH_SIDES) | contains_all(low, EITHER_SIDE))


def has_cashflow_signature(text: Column) -> Column:
    low = F.lower(text)
    return contains_all(low, ACTIVITIES) & contains_any(low, ENDING_CASH)


def segments(text: Column) -> Column:
    """A page's segments: what newlines, two blanks or more, " › " and "|" set apart, stripped."""
    return F.transform(F.split(text, r"[\n\r]| {2,}| › |\|", -1), strip)
