"""URL filters by host-suffix and path-prefix expressions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest by which expressions are joined; the full digests are compared afterwards.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://" or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on each url of pages (page_id, url) under rules (host, path, verdict).

    A rule fits its host and all subdomains, if the url's path starts with the rule's path. The longest host and path
    together win; among equally long rules the one with the longer host, then "block". Each url becomes expressions
    (host suffix, path prefix) of the label counts and path lengths that occur among the rules; they are joined with
    the rules on a short prefix of their SHA-256, and a hit counts only if the full digests agree. Rules are joined as
    Spark sees fit by their size, so there is no bound on them.

    Returns page_id, host, path, rule (host and path, or null) and verdict, one row for each row of pages, repeated
    rows included. Null urls and urls without "://" have an empty host and path, which no rule fits, and get `default`.
    Rules with a null column are left out, repeated rules count once; other columns are not read.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").dropna().distinct()
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    labels, lengths = sorted(shape["labels"] or []), sorted(shape["lengths"] or [])
    digest = lambda host, path: F.sha2(F.concat(host, F.lit(" "), path), 256)
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, PREFIX))

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    n = F.size(F.split("host", "\\."))
    suffixes = F.array_compact(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels])) if labels else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digest(h, p))))
    tried = urls.withColumn("digest", F.explode_outer(pairs)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    hits = tried.join(rules, "prefix", "left")
    sure = F.col("digest") == F.col("r_digest")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("verdict") == "block").cast("int"), "verdict")
    best = F.max(F.when(sure, F.struct(order.alias("order"), F.concat("r_host", "r_path").alias("rule"), "verdict"))).alias("best")
    judged = hits.groupBy("page_id", "host", "path", "copies").agg(best)
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
