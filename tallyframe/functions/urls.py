"""URLs of filings and investor pages, and the HTML that links to them."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.labels import BEGIN, BLANK, END, let, period_year, strip

#: Types of filings by patterns in their lower-case URL; the first that fits decides.
FILING_RULES = [
    ("Registration Document", rf"universal[-_ ]?registration|registration[-_ ]?document|{BEGIN}urd{END}|document[-_ ]?enregistrement|ra-rf"),
    ("Integrated Report", r"integrated[-_ ]?report"),
    ("ESG / Sustainability", rf"sustainab|{BEGIN}esg{END}|human[-_ ]?rights|responsibility|climate|environment|csrd|tcfd|non[-_ ]?financial"),
    ("Earnings Presentation", r"presentation|investor[-_ ]?deck|slides"),
    ("Half-Year Report", rf"half[-_ ]?year|halfyear|interim|semestriel|first[-_ ]?half|firsthalf|{BEGIN}h1{END}|1h20|9m"),
    ("Quarterly Statement", rf"quarter|{BEGIN}q[1-4]{END}|q[1-4]20"),
    ("Financial Statements", r"financial[-_ ]?statements?|financial[-_ ]?documents?|financialdocuments|documents?[-_ ]financiers?|document[-_ ]financier"),
    ("Annual Report", rf"annual[-_ ]?report|annualreport|annual_report|form[-_ ]?20[-_ ]?f|20f|nn-ar|{BEGIN}ar[0-9]{{2}}{END}"),
    ("Press Release", r"press|release|news|announcement|earnings|results"),
]
#: Legal forms and other words that don't tell companies apart.
STOP_WORDS = ["ag", "se", "sa", "nv", "as", "plc", "inc", "corp", "co", "ltd", "limited", "holding", "holdings", "group", "the", "company"]


def decoded(url: Column) -> Column:
    """Percent-decoded; "+" stays, and a URL that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def is_pdf_url(url: Column) -> Column:
    return url.rlike(r"(?i)\.pdf(\?|#|$)")


def is_pdf_href(href: Column) -> Column:
    return F.endswith(F.substring_index(F.lower(href), "?", 1), F.lit(".pdf"))


def host_of(url: Column) -> Column:
    """In lower case, without user and port; null without one. Lenient: a bad escape in the path doesn't matter."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def on_allowed_host(url: Column, hosts: Column) -> Column:
    """Whether the URL's host contains one of the strings in hosts."""
    host = host_of(url)
    return F.coalesce(F.exists(hosts, lambda h: F.contains(host, h)), F.lit(False))


def official_tokens(company: Column) -> Column:
    """The words by which a company's own hosts are known: its words joined, and each, of three letters at least."""
    words = F.split(F.regexp_replace(F.lower(company), "[^a-z0-9 ]", " "), " +", -1)
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.filter(F.concat(F.array(F.array_join(words, "")), words), lambda w: F.length(w) >= 3)


def is_official_host(url: Column, company: Column) -> Column:
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    return F.coalesce(F.exists(official_tokens(company), lambda t: F.contains(host, t)), F.lit(False))


def filing_title(url: Column) -> Column:
    last = F.element_at(F.split(F.substring_index(url, "?", 1), "/", -1), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), url)


def filing_year(title: Column) -> Column:
    short = F.nullif(F.regexp_extract(F.lower(title), f"ar[-_]?([0-9]{{2}}){END}", 1), F.lit(""))
    return F.coalesce(period_year(title), short.try_cast("int") + 2000)


def classify_filing(url: Column) -> Column:
    low = F.lower(decoded(url))
    out = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, pattern in FILING_RULES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("Other")


def strip_tags(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), f"{BLANK}+", " "))


def page_title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Characters that become delimiters when normalised, and so can't stand in a host.
_NO_HOST = "".join(c for c in map(chr, range(0x80, 0x10000)) if set(normalize("NFKC", c)) & set("/?#@:"))
#: An authority; brackets only around an address.
_AUTHORITY = rf"^(?:[^\[\]]*@)?(?:[^\[\]{_NO_HOST}]*|\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\](?::.*)?)$"
#: What may stand in a path without being encoded; a query and a fragment may hold more.
_PLAIN = r"A-Za-z0-9!$%&'()*+,\-./:;=@_~|^\[\]"
_PLAIN_QUERY, _PLAIN_FRAGMENT = _PLAIN + r"?{}`\\", _PLAIN + r"?{}\\#"


def _parts(url: Column) -> Column:
    """scheme (lower case), authority, path, query and fragment of a reference; empty where absent."""
    whole = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda n: F.regexp_extract(url, whole, n)
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


def _encoded(text: Column, plain: str) -> Column:
    """What isn't plain as the escapes of its UTF-8 bytes."""
    escaped = lambda x: F.when(x.rlike(f"^[{plain}]"), x).otherwise(F.regexp_replace(F.hex(x), "(..)", "%$1"))
    runs = F.regexp_extract_all(text, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))
    return F.when(text.rlike(f"^[{plain}]*$"), text).otherwise(F.array_join(F.transform(runs, escaped), ""))


def _merged_path(path: Column, base: Column) -> Column:
    """A link's path from the base's, without dot segments: a fold that goes up one part at each ".."."""
    relative = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(base, "[^/]*$", ""), path), "/+", "/")
    steps = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(relative), "/", -1)
    fold = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), fold), last), "/")
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def _written(u: Column) -> Column:
    """The URL of such parts; null without a scheme, or without a host where the scheme is http or https."""
    beside = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
    authority = F.lower(u["authority"])
    port = F.when(u["scheme"] == "http", ":80$").otherwise(":443$")
    path = F.when(u["path"] == "", "/").when(F.startswith(u["path"], F.lit("/")), u["path"]).otherwise(F.concat(F.lit("/"), u["path"]))
    web = F.concat(u["scheme"], F.lit("://"), F.regexp_replace(authority, port, F.lit("")), _encoded(path, _PLAIN), beside("?", _encoded(u["query"], _PLAIN_QUERY)), beside("#", _encoded(u["fragment"], _PLAIN_FRAGMENT)))
    other = F.concat(u["scheme"], F.lit(":"), beside("//", u["authority"]), u["path"], beside("?", u["query"]), beside("#", u["fragment"]))
    return F.when(u["scheme"].isin("http", "https"), F.when(u["authority"] != "", web)).when(u["scheme"] != "", other)


def resolve_url(href: Column, base: Column) -> Column:
    """The absolute URL of a link on a page, or null where there is none.

    Whole http(s) URLs and paths from a host's root in which nothing has to be encoded, lowered or removed are told by
    their look; other links are taken apart, joined and written again, by expressions as well. Hosts are lowered, default
    ports and empty queries and fragments left out. Whole URLs keep their dot segments. Relative links need an http(s) base.
    """
    tail = rf"/[{_PLAIN}]*(?:\?[{_PLAIN}]+)?(?:#[{_PLAIN}]+)?"
    origin = F.nullif(F.regexp_extract(base, r"^(https?://[a-z0-9.-]+)(?:[/?#]|$)", 1), F.lit(""))
    plain = F.when(href.rlike(rf"^https?://[a-z0-9.-]+{tail}$") & ~href.rlike(r"/\.{1,2}(?:[/?#]|$)"), href).when(href.rlike(rf"^{tail}$") & ~href.rlike(r"^//|/\.{1,2}(?:[/?#]|$)"), F.concat(origin, href))
    bare = lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\t\n\r]", "")
    both = F.struct(_parts(bare(strip(href))).alias("link"), _parts(bare(base)).alias("base"), (bare(strip(href)) == "").alias("none"))

    def joined(x: Column) -> Column:
        link, of = x["link"], x["base"]
        relative = (link["scheme"] == "") | ((link["scheme"] == of["scheme"]) & of["scheme"].isin("http", "https"))
        path = F.when(link["path"] == "", of["path"]).otherwise(_merged_path(link["path"], of["path"]))
        query = F.when((link["path"] == "") & (link["query"] == ""), of["query"]).otherwise(link["query"])
        own = F.struct(of["scheme"].alias("scheme"), of["authority"].alias("authority"), path.alias("path"), query.alias("query"), link["fragment"].alias("fragment"))
        out = F.when(x["none"], of).when(~relative, link).when(of["scheme"].isin("http", "https"), F.when(link["authority"] == "", own).otherwise(link.withField("scheme", of["scheme"])))
        return F.when(link["authority"].rlike(_AUTHORITY) & of["authority"].rlike(_AUTHORITY), out)

    return F.coalesce(plain, F.when(href.isNotNull() & base.isNotNull(), let(let(both, joined), _written)))


def search_results(html: Column, most: int = 8) -> Column:
    """array<struct(title, url)> of a stored search-result page: the first results, redirects unwrapped."""
    found = F.slice(F.regexp_extract_all(html, F.lit(r'<a[^>]+class="result__a"[^>]+href="[^"]+"[^>]*>.*?</a>'), F.lit(0)), 1, most)

    def one(a: Column) -> Column:
        href = F.regexp_extract(a, r'class="result__a"[^>]+href="([^"]+)"', 1)
        inner = F.nullif(F.regexp_extract(href, "[?&]uddg=([^&]+)", 1), F.lit(""))
        return F.struct(strip_tags(F.regexp_extract(a, "^<a[^>]*>(.*?)</a>$", 1)).alias("title"), F.coalesce(decoded(inner), href).alias("url"))

    return F.transform(found, one)
