"""Resolution of not-modified revisit records by an as-of join with earlier full responses of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import small, stored

#: Headers that a not-modified answer may renew (fixed values); all others stay as they came with the full response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
HEADERS = "array<struct<key:string,value:string>>"


#: Captures of one URL that are ordered together at most, where their times allow it.
SLOT_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without "www." and its scheme's own port (user names stay as they are), the path as it
    is or "/", no query or fragment marks that only track (utm_*), no fragment. Null stays null; what isn't scheme://… is
    only trimmed."""
    x = F.trim(F.regexp_replace(url, "#.*$", ""))
    scheme = F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    user = F.regexp_extract(rest, "^([^/?]*@)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^(?:[^/?]*@)?([^/?]*)", 1)), "^www\\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    query = F.array_join(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    whole = F.concat(scheme, F.lit("://"), user, host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme == "", x).otherwise(whole)


def _entries(headers: Column) -> Column:
    """A map's entries by name in lower case, in order; of several values of a name the greatest."""
    sorted_ = F.array_sort(F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"))))
    one = F.transform(F.array(sorted_), lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["key"] != x["key"], F.lit(True))))
    return F.get(one, F.lit(0))


def resolve_revisits(records: DataFrame, slot_seconds: int = 86400, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Each revisit of records (record_id, url, at, kind, etag, last_modified, digest, headers) with what it stands for.

    kind is "response" (a full one) or "revisit"; headers is map<string,string>, its names compared in lower case. A
    revisit belongs to the latest full response of its canonical URL that is earlier than it (ties of time: the greatest
    record_id). It holds if the first validator that both sides have agrees: etag (weak comparison, without W/), else
    last_modified, else digest; with none in common it is "unverified", with a differing one "mismatch", with no earlier
    response "unresolved". Resolved and unverified revisits get the response's headers, overridden by the permitted ones
    they bring.

    Returns record_id, canonical, at, status, response_id, headers, digest of the revisits. Time is cut into slots: the
    latest response in each (URL, slot) is found by a partial aggregate, carried over the slots by a window over the few
    slot rows, and then only rows of one slot are ordered together. A slot of more than slot_rows captures is cut further,
    evenly in time, so a URL with very many captures is dealt out. Rows with null url or at are unresolved and meet
    nothing; null kind counts as neither; repeated rows give repeated results; null headers are none; other columns are
    not read. Bodies don't travel: join on response_id for them. No rows give no rows.
    """
    entries = _entries(F.col("headers")).alias("entries")
    every = records.where("kind in ('response', 'revisit')").select(canonical_url(F.col("url")).alias("canonical"), "record_id", "at", "kind", "etag", "last_modified", "digest", entries)
    known = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    span = slot_seconds * 1_000_000
    r = every.where(known).withColumn("day", F.floor(F.unix_micros("at") / span))
    full = r.groupBy("canonical", "day").agg(F.ceil(F.count("*") / slot_rows).alias("cuts")).where("cuts > 1")
    full = stored(full)
    r = r.join(small(full, full.count()), ["canonical", "day"], "left")
    cut = F.floor(F.pmod(F.unix_micros("at"), F.lit(span)) / span * F.coalesce("cuts", F.lit(1)))
    r = r.withColumn("slot", F.struct("day", cut.alias("cut"))).drop("day", "cuts")
    seen = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "digest", "entries"))
    per_slot = r.groupBy("canonical", "slot").agg(F.max(seen).alias("last_full"))
    before = Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = per_slot.select("canonical", "slot", F.last("last_full", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    earlier = Window.partitionBy("canonical", "slot").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("own", F.max(seen).over(earlier)).where("kind = 'revisit'").join(slots, ["canonical", "slot"], "left")
    r = r.withColumn("base", F.coalesce("own", "carried")).drop("slot", "own", "carried")
    r = r.unionByName(every.where(~known & (F.col("kind") == "revisit")), allowMissingColumns=True)

    weak = lambda e: F.regexp_replace(e, "^W/", "")
    status = F.when(F.col("base").isNull(), "unresolved")
    for mine, theirs in ((weak(F.col("etag")), weak(F.col("base.etag"))), (F.col("last_modified"), F.col("base.last_modified")), (F.col("digest"), F.col("base.digest"))):
        status = status.when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("mismatch"))
    r = r.withColumn("status", status.otherwise("unverified"))
    holds = F.col("status").isin("resolved", "unverified")
    renewed = F.filter(F.coalesce("entries", F.array().cast(HEADERS)), lambda x: x["key"].isin(PERMITTED))
    kept = F.filter(F.coalesce("base.entries", F.array().cast(HEADERS)), lambda x: ~F.exists(renewed, lambda y: y["key"] == x["key"]))
    merged = F.map_from_entries(F.array_sort(F.concat(kept, renewed)))
    return r.select(
        "record_id", "canonical", "at", "status", F.when(holds, F.col("base.record_id")).alias("response_id"),
        F.when(holds, merged).alias("headers"), F.when(holds, F.coalesce("base.digest", "digest")).alias("digest"),
    )
