"""Where a report's pages hold its statements.

pages: slug, report_year, page_index, text. A report is keyed by (slug, report_year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import pages as P
from tallyframe.functions.labels import let

REPORT = ["slug", "report_year"]


def looks_english(pages: DataFrame, max_pages: int = 30, min_words: int = 200, ratio: float = 0.05) -> DataFrame:
    """slug, report_year, words, hits, english: whether common English words are more than `ratio` of the words of the
    first max_pages pages; reports of fewer than min_words words pass."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    p = pages.where(F.col("page_index") < max_pages).select(*REPORT, words.alias("w"))
    p = p.select(*REPORT, F.size("w").alias("n"), F.size(F.filter("w", lambda x: x.isin(P.ENGLISH_WORDS))).alias("h"))
    g = p.groupBy(*REPORT).agg(F.sum("n").alias("words"), F.sum("h").alias("hits"))
    return g.withColumn("english", (F.col("words") < min_words) | (F.col("hits") / F.col("words") > ratio))


def english_filter(pages: DataFrame, max_pages: int = 30, min_words: int = 200, ratio: float = 0.05) -> DataFrame:
    other = looks_english(pages, max_pages, min_words, ratio).where("not english").select(*REPORT)
    return pages.join(other, REPORT, "left_anti")


def boilerplate_segments(pages: DataFrame, share: float = 0.25, min_len: int = 4) -> DataFrame:
    """slug, report_year, seg, n_pages of the segments on more than `share` of a report's pages. Short segments and
    repeats on one page go before the shuffle."""
    total = pages.groupBy(*REPORT).agg(F.count("*").alias("total"))
    seg = pages.select(*REPORT, F.explode(F.filter(F.array_distinct(P.segments(F.col("text"))), lambda s: F.length(s) >= min_len)).alias("seg"))
    n = seg.groupBy(*REPORT, "seg").agg(F.count("*").alias("n_pages"))
    return n.join(total, REPORT).where(F.col("n_pages") > F.col("total") * share).select(*REPORT, "seg", "n_pages")


def strip_boilerplate(pages: DataFrame, share: float = 0.25, min_len: int = 4) -> DataFrame:
    """pages whose text is its segments that aren't boilerplate, joined by blanks. A report's boilerplate, at most a few
    segments a page, travels to its pages as one array."""
    found = boilerplate_segments(pages, share, min_len).groupBy(*REPORT).agg(F.collect_list("seg").alias("boilerplate"))
    return pages.join(found, REPORT, "left").select(*REPORT, "page_index", _without(F.col("text"), F.col("boilerplate")).alias("text"))


def _without(text: Column, boilerplate: Column) -> Column:
    """The text's segments but boilerplate. The two sets meet once a page, hashed; a segment is then only looked for among
    the boilerplate on its own page."""
    without = lambda parts, found: F.filter(parts, lambda s: ~F.coalesce(F.array_contains(found, s), F.lit(False)))
    kept = let(P.segments(text), lambda parts: let(F.array_intersect(parts, boilerplate), lambda found: without(parts, found)))
    return F.array_join(kept, " ")


def heading_map(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*REPORT, "page_index", P.heading_of(F.col("text")).alias("head")).where("head is not null")


def candidate_pages(pages: DataFrame, min_score: int = 3, k: int = 3) -> DataFrame:
    """The k best pages for each kind: slug, report_year, kind, page_index, score, rank (from 1; ties by page)."""
    low = pages.select(*REPORT, "page_index", P.digest(F.lower("text")).alias("low"))
    scores = F.array(*[F.struct(F.lit(kind).alias("kind"), P.page_score(F.col("low"), kind).alias("score")) for kind in P.KINDS])
    s = low.select(*REPORT, "page_index", F.explode(F.filter(scores, lambda x: x["score"] >= min_score)).alias("x"))
    s = s.select(*REPORT, "x.kind", "page_index", "x.score")
    rank = F.row_number().over(Window.partitionBy(*REPORT, "kind").orderBy(F.desc("score"), "page_index"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def candidate_union(candidates: DataFrame) -> DataFrame:
    return candidates.select(*REPORT, "page_index").distinct()


def resolve_picks(candidates: DataFrame, headings: DataFrame, locator_picks: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One page for each report and kind, where there is one: an override, else a locator's pick that is in the heading
    map, else the best candidate. locator_picks and overrides: slug, report_year, kind, page_index."""
    parts = [candidates.where("rank = 1").select(*REPORT, "kind", "page_index", F.lit(2).alias("place"))]
    if locator_picks is not None:
        valid = locator_picks.where("page_index is not null").join(headings.select(*REPORT, "page_index").distinct(), [*REPORT, "page_index"], "left_semi")
        parts.append(valid.select(*REPORT, "kind", "page_index", F.lit(1).alias("place")))
    if overrides is not None:
        parts.append(overrides.where("page_index is not null").select(*REPORT, "kind", "page_index", F.lit(0).alias("place")))
    p = parts[0]
    for x in parts[1:]:
        p = p.unionByName(x)
    return p.groupBy(*REPORT, "kind").agg(F.min_by("page_index", F.struct("place", "page_index")).alias("page_index"))


def snap_to_signature(picks: DataFrame, pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """picks with balance and cashflow moved to the page that bears their signature, nearest to the income pick (ties and
    no income pick: the lower page); unmoved where no page has it or an override pins the kind."""
    text = F.col("text")
    kinds = F.array_compact(F.array(F.when(P.has_balance_signature(text), "balance"), F.when(P.has_cashflow_signature(text), "cashflow")))
    hits = pages.select(*REPORT, "page_index", F.explode(kinds).alias("kind"))
    if overrides is not None:
        hits = hits.join(overrides.where("page_index is not null").select(*REPORT, "kind").distinct(), [*REPORT, "kind"], "left_anti")
    income = picks.where("kind = 'income'").select(*REPORT, F.col("page_index").alias("near"))
    far = F.abs(F.col("page_index") - F.col("near"))
    best = hits.join(income, REPORT, "left").groupBy(*REPORT, "kind").agg(F.min_by("page_index", F.struct(F.coalesce(far, F.lit(0)), "page_index")).alias("snapped"))
    both = picks.join(best, [*REPORT, "kind"], "full")
    return both.select(*REPORT, "kind", F.coalesce("snapped", "page_index").alias("page_index"))


def other_titles(kind: str) -> list[str]:
    """Titles that a page of this kind of statement doesn't bear."""
    return [h for o in P.KINDS if o != kind for h in P.HEADINGS[o]] + P.OTHER_STATEMENTS


def statement_spans(picks: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The pages of each statement: slug, report_year, kind, page_index. A page beside a pick belongs to it if it exists,
    is no pick, and bears no other statement's title; one page goes to one statement, of the lower pick (then by kind)."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(P.KINDS) for x in (k, i)])
    beside = picks.select(*REPORT, "kind", F.col("page_index").alias("pick"), F.explode(F.array(F.col("page_index") - 1, F.col("page_index") + 1)).alias("page_index"))
    low = F.lower("text")
    marks = cleaned.select(*REPORT, "page_index", *[P.contains_any(low, other_titles(k)).alias(f"not_{k}") for k in P.KINDS])
    b = beside.join(marks, [*REPORT, "page_index"]).join(picks.select(*REPORT, "page_index").distinct(), [*REPORT, "page_index"], "left_anti")
    barred = F.lit(False)
    for k in P.KINDS:
        barred = F.when(F.col("kind") == k, F.col(f"not_{k}")).otherwise(barred)
    b = b.where(~barred)
    first = F.row_number().over(Window.partitionBy(*REPORT, "page_index").orderBy("pick", F.element_at(place, F.col("kind"))))
    b = b.withColumn("first", first).where("first = 1").select(*REPORT, "kind", "page_index")
    return b.unionByName(picks.select(*REPORT, "kind", "page_index").where("page_index is not null"))


def statement_text(spans: DataFrame, pages: DataFrame, max_chars: int = 12000) -> DataFrame:
    """The original text of each statement's pages in order, newline between, cut at max_chars."""
    return _assembled(spans.join(pages.select(*REPORT, "page_index", "text"), [*REPORT, "page_index"]), max_chars)


def _features(pages: DataFrame) -> DataFrame:
    """What locating asks of each page (with text and clean, its text without boilerplate), without any text: page_index,
    score_<kind>, signed_<kind>, head, not_<kind>. Each text is searched for phrases once; the rest is told from what it says."""
    low, titles = F.col("low"), F.col("titles")
    p = pages.withColumn("low", P.digest(F.lower("text"))).withColumn("clean", F.lower("clean"))
    p = p.withColumn("titles", P.said(F.col("clean"), [*[h for k in P.KINDS for h in P.HEADINGS[k]], *P.OTHER_STATEMENTS]))
    return p.select(
        *REPORT, "page_index", *[P.page_score(low, k).alias(f"score_{k}") for k in P.KINDS],
        P.has_balance_signature(low).alias("signed_balance"), P.has_cashflow_signature(low).alias("signed_cashflow"),
        P.is_landmark(F.col("clean")).alias("head"), *[P.contains_any(titles, other_titles(k)).alias(f"not_{k}") for k in P.KINDS],
    )


def locate(pages: DataFrame, locator_picks: DataFrame | None = None, overrides: DataFrame | None = None, min_score: int = 3, share: float = 0.25, min_len: int = 4) -> DataFrame:
    """One row for each report: slug, report_year, picks (the page_index of each kind) and spans (array of kind,
    page_index); the same as resolve_picks, snap_to_signature and statement_spans over tables of pages, in one pass.

    Pages are shuffled once, by report; boilerplate is counted and taken out there, and each page becomes a few flags.
    These, and the given picks and overrides, meet once more as one narrow array a report, over which everything else is
    expressions. locator_picks and overrides: slug, report_year, kind, page_index; kinds other than the three don't count.
    """
    p = pages.select(*REPORT, "page_index", "text").repartition(*REPORT)
    found = boilerplate_segments(p, share, min_len).groupBy(*REPORT).agg(F.collect_list("seg").alias("boilerplate"))
    p = p.join(found.hint("shuffle_hash"), REPORT, "left").withColumn("clean", _without(F.col("text"), F.col("boilerplate")))
    given = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("page_index"), F.lit(0).alias("place"))
    f = _features(p)
    names = [c for c in f.columns if c not in REPORT]
    f = f.select(*REPORT, F.struct(*names).alias("page"), given.alias("given"))
    for place, df in ((0, overrides), (1, locator_picks)):
        if df is not None:
            row = F.struct("kind", F.col("page_index").cast("int").alias("page_index"), F.lit(place).alias("place"))
            f = f.unionByName(df.where("page_index is not null").select(*REPORT, row.alias("given")), allowMissingColumns=True)
    g = f.groupBy(*REPORT).agg(F.collect_list("page").alias("pages"), F.collect_list(F.when(F.col("given.kind").isNotNull(), F.col("given"))).alias("given"))
    known = lambda x: F.exists("pages", lambda p: (p["page_index"] == x["page_index"]) & p["head"])
    for k in P.KINDS:
        own = lambda place, fine: F.array_min(F.transform(F.filter("given", lambda x: (x["kind"] == k) & (x["place"] == place) & fine(x)), lambda x: x["page_index"]))  # noqa: B023, E731
        best = F.array_max(F.transform(F.filter("pages", lambda p: p[f"score_{k}"] >= min_score), lambda p: F.struct(p[f"score_{k}"].alias("s"), (-p["page_index"]).alias("low"))))  # noqa: B023
        g = g.withColumn(f"pinned_{k}", own(0, lambda x: F.lit(True))).withColumn(f"pick_{k}", F.coalesce(own(1, known), -best["low"]))
        g = g.withColumn(f"pick_{k}", F.coalesce(f"pinned_{k}", f"pick_{k}"))
    for k in P.KINDS[1:]:
        far = lambda p: F.coalesce(F.abs(p["page_index"] - F.col("pick_income")), F.lit(0))
        signed = F.transform(F.filter("pages", lambda p: p[f"signed_{k}"]), lambda p: F.struct(far(p).alias("far"), p["page_index"].alias("page_index")))  # noqa: B023
        g = g.withColumn(f"pick_{k}", F.coalesce(F.when(F.col(f"pinned_{k}").isNull(), F.array_min(signed)["page_index"]), f"pick_{k}"))
    picks = F.array_compact(F.array(*[F.when(F.col(f"pick_{k}").isNotNull(), F.struct(F.col(f"pick_{k}").alias("pick"), F.lit(n).alias("place"), F.lit(k).alias("kind"))) for n, k in enumerate(P.KINDS)]))
    g = g.withColumn("picks", picks).withColumn("at", F.transform("picks", lambda x: x["pick"]))
    free = lambda page, k: F.exists("pages", lambda p: (p["page_index"] == page) & ~p[f"not_{k}"]) & ~F.array_contains("at", page)
    beside = [F.when(free(F.col(f"pick_{k}") + d, k), F.struct((F.col(f"pick_{k}") + d).alias("page_index"), F.struct(F.col(f"pick_{k}").alias("pick"), F.lit(n).alias("place")).alias("order"), F.lit(k).alias("kind"))) for n, k in enumerate(P.KINDS) for d in (-1, 1)]
    g = g.withColumn("beside", F.array_compact(F.array(*beside)))
    first = F.filter("beside", lambda x: ~F.exists("beside", lambda o: (o["page_index"] == x["page_index"]) & (o["order"] < x["order"])))
    span = lambda page: lambda x: F.struct(x["kind"].alias("kind"), x[page].alias("page_index"))
    spans = F.concat(F.transform(first, span("page_index")), F.transform("picks", span("pick")))
    return g.select(*REPORT, F.transform("picks", span("pick")).alias("picks"), spans.alias("spans"))


def located_rows(located: DataFrame, column: str = "spans") -> DataFrame:
    """slug, report_year, kind, page_index of what locate found: its spans, or its picks."""
    return located.select(*REPORT, F.inline_outer(column)).where("kind is not null")


def located_text(located: DataFrame, pages: DataFrame, max_chars: int = 12000) -> DataFrame:
    """statement_text of what locate found: each report's row meets its pages, of which only those in a span go further."""
    p = pages.select(*REPORT, "page_index", "text").repartition(*REPORT).join(located.select(*REPORT, "spans").hint("shuffle_hash"), REPORT)
    kinds = F.transform(F.filter("spans", lambda x: x["page_index"] == F.col("page_index")), lambda x: x["kind"])
    s = p.select(*REPORT, "page_index", "text", kinds.alias("kinds")).where(F.size("kinds") > 0)
    return _assembled(s.select(*REPORT, "page_index", "text", F.explode("kinds").alias("kind")), max_chars)


def _assembled(spans: DataFrame, max_chars: int) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("page_index", F.coalesce("text", F.lit("")).alias("text"))))
    s = spans.groupBy(*REPORT, "kind").agg(parts.alias("parts"))
    return s.select(*REPORT, "kind", F.substring(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), 1, max_chars).alias("text"))


def parse_page_overrides(df: DataFrame, column: str = "pages") -> DataFrame:
    """Overrides such as "income:198,balance:199" exploded to kind, page_index beside the other columns; parts of unknown
    kinds or without a number are left out, of repeated kinds the last counts."""
    rest = [c for c in df.columns if c != column]
    parts = F.transform(F.split(column, ","), lambda x: F.transform(F.split(x, ":"), lambda y: F.trim(y)))
    good = F.filter(parts, lambda x: F.get(x, F.lit(0)).isin(P.KINDS) & F.coalesce(F.get(x, F.lit(1)).rlike("^[0-9]+$"), F.lit(False)))
    e = df.select(*rest, F.posexplode(good).alias("n", "x")).select(*rest, "n", F.col("x")[0].alias("kind"), F.col("x")[1].try_cast("int").alias("page_index"))
    return e.groupBy(*rest, "kind").agg(F.max_by("page_index", "n").alias("page_index"))
