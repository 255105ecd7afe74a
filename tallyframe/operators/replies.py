"""Transcribed statements: from a model's replies to clean reports. replies: slug, report_year, kind, reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import strip
from tallyframe.operators.compiling import ROWS

REPLY = "struct<periods:array<string>,rows:array<struct<label:string,kind:string,unit:string,decimals:int,values:array<string>>>>"


def reply_json(reply: Column) -> Column:
    """The JSON in a reply: without a code fence, from the first { to the last }; null if that is no JSON."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(reply), "(?i)^```(?:json)?", ""), "```$", ""))
    cut = F.when(reply.contains("{") & reply.contains("}"), F.regexp_extract(reply, r"(?s)\{.*\}", 0)).otherwise(bare)
    # an array of one, so that the cut is worked out once
    return F.get(F.filter(F.array(cut), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def fit_values(values: Column, n: Column) -> Column:
    """values cut or filled up with nulls to n of them; as they are for n = 0."""
    filled = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("double"), n)), F.lit(1), n)
    return F.when(n > 0, filled).otherwise(values)


def parse_replies(replies: DataFrame) -> DataFrame:
    """Reports of the replies: slug, report_year, kind, periods, rows, n_mismatched.

    A reply that is no JSON is an empty statement. Rows without a label go, missing values are none, and each row but
    sections is fitted to the number of periods; n_mismatched counts those that had to be.
    """
    r = replies.select("slug", "report_year", "kind", F.from_json(reply_json(F.col("reply")), REPLY).alias("x"))
    r = r.withColumn("periods", F.coalesce("x.periods", F.array().cast("array<string>")))
    n = F.size("periods")
    numbers = lambda v: F.coalesce(F.transform(v, lambda y: y.try_cast("double")), F.array().cast("array<double>"))
    row = lambda x, v: F.struct(x["label"].alias("label"), x["kind"].alias("kind"), x["unit"].alias("unit"), x["decimals"].alias("decimals"), v.alias("values"))
    rows = F.transform(F.filter(F.coalesce("x.rows", F.array().cast("array<struct<label:string,kind:string,unit:string,decimals:int,values:array<string>>>")), lambda x: x["label"].isNotNull()), lambda x: row(x, numbers(x["values"])))
    r = r.withColumn("raw", rows)
    off = lambda x: (F.coalesce(x["kind"], F.lit("")) != "section") & (n > 0) & (F.size(x["values"]) != n)
    fitted = F.transform("raw", lambda x: row(x, F.when(off(x), fit_values(x["values"], n)).otherwise(x["values"])))
    return r.select("slug", "report_year", "kind", "periods", fitted.cast(ROWS).alias("rows"), F.size(F.filter("raw", off)).alias("n_mismatched"))


def reply_quality(reports: DataFrame) -> DataFrame:
    return reports.select("slug", "report_year", "kind", "n_mismatched")
