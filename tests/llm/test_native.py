"""Chat windows, URL filter, revisits, sharding: against SQL, brute force and cases by hand."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat, oracles, sharding, urlfilter, warc
from tallyframe.llm import queries as Q

TURNS = "conv_id long, turn long, role string, text string, turn_tokens int"


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_query_equals_sql(same, name):
    assert same(Q.queries()[name], oracles.SQL[name]) > 0


def windows(spark, rows, **options):
    return chat.chat_windows(spark.createDataFrame([(*r, 0) for r in rows], TURNS), **options)


def test_chat_round_trip_and_budget(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "a\\l<b#\\\\", " </turn>\n### user: ", "é😀" * 50]
    rows = [(1, 0, "system", "be kind")] + [(1, 1 + i, ["user", "assistant", "a: b#", None][i % 4], odd[i % 6]) for i in range(40)] + [(2, 0, "assistant", "x" * 5000), (2, 1, "user", "hi"), (3, 0, "system", "only")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (None, None, None, None)]
    w = windows(spark, rows, budget=120)
    got = {r.conv_id: r for r in chat.conversation_digests(w).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in w.collect():
        assert r.over_budget == (r.n_tokens > 120)
        if r.over_budget:
            assert r.n_new == 1  # a turn that alone is too long
        if r.conv_id == 1:
            assert r.text.startswith("### system: be kind </turn>\n")
    assert w.where("conv_id = 1 and n_repeated > 1").count() > 0


def test_chat_no_rows(spark):
    assert chat.conversation_digests(windows(spark, [])).count() == 0


def test_urls_brute_force(spark):
    import random

    rng = random.Random(3)
    rules = [("com", "/", "allow"), ("b.com", "/x", "block"), ("a.b.com", "/", "allow"), ("b.com", "/x", "allow"), ("com", "/xyz/", "block"), ("Net", "/", "block"), ("net", "/", "block"), ("c.net", "", "allow"), (None, "/", "block")]
    urls = ["".join(rng.choice(["http://", "x://", "", "://"]) + rng.choice(["a.b.com", "b.com", "xb.com", "A.B.COM", "c.net", "net", "d..net", "com", ""]) + rng.choice(["", "/", "/x", "/xyz/q", "?/x", "#/", "/é", ":80/x"])) for _ in range(300)] + [None, "", "x" * 9000]
    pages = spark.createDataFrame([(i % 290, u, "html") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = Counter(tuple(r) for r in urlfilter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = Counter()
    for i, u in [*((i % 290, u) for i, u in enumerate(urls)), (0, urls[0])]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        want[(i, host, path, best and best[3], best[4] if best else "allow")] += 1
    assert got == want
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert urlfilter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow' and rule is null").count() == len(urls) + 1


def test_revisits(spark):
    schema = "record_id long, url string, at_s long, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical string"
    rows = [
        (1, "http://www.A.com/x#f", 1000, "response", '"e"', None, "d1", {"etag": '"e"', "server": "s", "date": "0"}, ""),
        (2, "http://a.com/x", 1000, "revisit", '"e"', None, None, {}, ""),  # not earlier
        (3, "http://a.com:80/x?utm_a=1", 200_000, "revisit", 'W/"e"', None, None, {"date": "9", "server": "no"}, ""),
        (4, "http://a.com/x", 300_000, "response", None, "m", "d2", None, ""),
        (5, "http://a.com/x", 300_001, "revisit", '"e"', "m2", None, None, ""), (6, "http://a.com/x", 900_000, "revisit", None, None, None, {"vary": "v"}, ""),
        (7, None, 900_000, "revisit", None, None, None, None, ""), (8, "http://a.com/x", None, "revisit", None, None, None, None, ""), (9, "http://a.com/x", 1, None, None, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows + rows[2:3], schema).withColumn("at", F.timestamp_seconds("at_s"))
    got = sorted(((r.record_id, r.status, r.response_id, r.headers) for r in warc.resolve_revisits(df).collect()), key=lambda r: r[0])
    kept = {"etag": '"e"', "server": "s", "date": "9"}
    assert got == [(2, "unresolved", None, None), (3, "resolved", 1, kept), (3, "resolved", 1, kept), (5, "mismatch", None, None), (6, "unverified", 4, {"vary": "v"}), (7, "unresolved", None, None), (8, "unresolved", None, None)]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_shards(spark):
    texts = ["hot"] * 900 + [None] * 5 + [""] * 5 + [f"text {i} " * (i % 40) for i in range(1500)] + ["long " * 3000]
    docs = spark.createDataFrame([(i if i % 7 else i // 2, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = sharding.shard_documents(docs, 4).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i if i % 7 else i // 2, len((t or "").encode()) + 1) for i, t in enumerate(texts))
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r)
    assert set(per) == {0, 1, 2, 3} and all(sorted(r.slot for r in x) == list(range(len(x))) for x in per.values())
    size = [sum(r.size for r in x) for x in per.values()]
    assert max(size) - min(size) <= max(r.size for r in rows)
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


def test_place_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, (200, 3)).astype(float)
    to = np.array([x[0][0] for x in sharding.place(sizes, 5, np.ones(200, bool))])
    share = np.stack([sizes[to == k].sum(0) for k in range(5)]) / sizes.sum(0)
    assert np.abs(share - 0.2).max() < 0.02


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.A.com:80/x": "http://a.com/x", "https://a.com:80/x": "https://a.com:80/x", "http://a.com:443": "http://a.com:443/", "https://a.com:443?utm_x=1&b=2#f": "https://a.com/?b=2",
        "http://Me:Pw@www.A.com/": "http://Me:Pw@a.com/", "ftp://www.a.com:80/": "ftp://a.com:80/", "  plain ": "plain", "": "", None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.c for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).collect()} == cases


def test_revisits_of_a_hot_url_and_ties(spark):
    """Slots cut further give what one slot gives; of responses at one time the greatest id counts; header names in any case."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["http://a.com/", "http://a.com/", "http://b.com/"]), rng.randrange(300), rng.choice(["response", "revisit", "revisit"]), rng.choice(['"e"', '"f"', None]), {"ETag": "x", "etag": "y", "Server": "s"} if i % 2 else {"Date": str(i)}) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, etag string, headers map<string,string>").withColumn("at", F.timestamp_seconds("s"))
    df = df.withColumn("last_modified", F.lit(None).cast("string")).withColumn("digest", F.lit(None).cast("string")).withColumn("slot", F.lit(1)).withColumn("day", F.lit(1))
    want = {}
    for i, u, s, kind, etag, h in rows:
        if kind == "revisit":
            full = [r for r in rows if r[1] == u and r[3] == "response" and r[2] < s]
            base = max(full, key=lambda r: (r[2], r[0]), default=None)
            same = base and (None if etag is None or base[4] is None else etag == base[4])
            low = lambda m: {k: max(v for x, v in m.items() if x.lower() == k) for k in {x.lower() for x in m}}
            merged = base and {**low(base[5]), **{k: v for k, v in low(h).items() if k in warc.PERMITTED}}
            want[i] = ("unresolved", None, None) if base is None else ("mismatch", None, None) if same is False else ("resolved" if same else "unverified", base[0], merged)
    for slot_rows in (100_000, 20):
        got = {r.record_id: (r.status, r.response_id, r.headers) for r in warc.resolve_revisits(df, slot_rows=slot_rows).collect()}
        assert got == want
