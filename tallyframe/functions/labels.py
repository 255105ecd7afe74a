"""Labels, periods and figures of statement rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as in report texts: Java's \s and the Unicode blanks.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: ASCII word boundaries, whatever letters stand around.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Rewritings of a lower-case label, in order, that make wordings of one line item equal.
KEY_REWRITES = [
    (r"\([a-z]?\.?\d+\)", " "),
    (r"\((loss|profit|gain|income|expense|net)\)", " "),
    (r"[^a-z0-9]+", " "),
    (r"\b(increase decrease|decrease increase)\b", "change"),
    (r"([a-z])\d+\b", "$1"),
    (r"\b(generated (from|by)|provided by|used (in|for)|flows? from)\b", "from"),
    (r" for the (financial )?(year|period)\b", ""),
    (r"\s+", " "),
]
#: Fixed value: the key that stands for another (looked up in singular form).
KEY_ALIAS = {"total revenue": "revenue"}
#: Symbols of currencies.
CURRENCY_SYMBOLS = {"EUR": "€", "DKK": "kr", "USD": "$", "GBP": "£", "CHF": "CHF"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once for a row: a fold over nothing, as a transform would copy what body gives."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def places(values: Column) -> Column:
    """The first place (from 0) of each value of an array, as a map to be asked by try_element_at; nulls have none. In a
    lambda array_position takes long, as it throws whatever it finds."""
    first = lambda x: (F.array_position(values, x) - 1).cast("int")
    each = lambda d: F.when(F.size(d) == F.size(values), F.transform(d, lambda _, i: i)).otherwise(F.transform(d, first))
    return let(F.array_distinct(F.array_compact(values)), lambda d: F.map_from_arrays(d, each(d)))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ss"), word)
        .when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("xes"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def canon_key(label: Column) -> Column:
    """The key under which a row's wordings in different reports meet; null for null."""
    k = F.lower(label)
    for pattern, to in KEY_REWRITES:
        k = F.regexp_replace(k, pattern, to)
    # each step names the one before once only, as Spark works a repeated expression out again
    s = F.array_join(F.transform(F.split(F.trim(k), " ", -1), singular), " ")
    for name, key in KEY_ALIAS.items():
        s = F.regexp_replace(s, f"^{name}$", key)
    return F.coalesce(F.get(F.filter(F.array(s, F.lower(strip(label))), lambda x: x != ""), F.lit(0)), strip(label))


_REWRITES = [(re.compile(pattern, re.ASCII), to.replace("$", "\\")) for pattern, to in KEY_REWRITES]


def _singular(word: str) -> str:
    if word.endswith("ss") or not word.endswith("s"):
        return word
    return word[:-3] + "y" if word.endswith("ies") else word[:-2] if word.endswith("xes") else word[:-1]


@lru_cache(maxsize=100_000)
def ascii_key(label: str | None) -> str | None:
    """canon_key of an ASCII label; None for others, where engines' ideas of letters may differ."""
    if label is None or not label.isascii():
        return None
    k = label.lower()
    for pattern, to in _REWRITES:
        k = pattern.sub(to, k)
    s = " ".join(map(_singular, k.strip(" ").split(" ")))
    return KEY_ALIAS.get(s, s) or label.lower().strip(BLANKS)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _ascii_keys(labels: pa.Array) -> pa.Array:
    d = labels.values.dictionary_encode()
    keys = pa.array([ascii_key(x) for x in d.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(labels.offsets, keys.take(d.indices))


def canon_keys(labels: Column) -> Column:
    """canon_key of each label of an array, empty for null. Few labels are new, so a batch's distinct ones are rewritten,
    those that aren't ASCII one by one."""
    given = F.coalesce(labels, F.array().cast("array<string>"))
    return F.zip_with(given, _ascii_keys(given), lambda label, key: F.coalesce(key, canon_key(label)))


def clean_label(label: Column) -> Column:
    """The label to show: without note references, footnote digits and double blanks."""
    # fixed values: both patterns
    x = F.regexp_replace(label, rf"(?:{BLANK}|,)*\([A-Za-z]?\.?\d+\)", "")
    x = F.regexp_replace(x, rf"([A-Za-z])\d+{END}", "$1")
    return strip(F.regexp_replace(x, BLANK + "{2,}", " "))


def is_expense_label(label: Column) -> Column:
    """Whether a row of this label is a pure cost, which statements show as negative."""
    low = F.lower(label)
    # fixed values: the words, and their order of precedence
    return (
        F.when(low.contains("income") & low.contains("expense"), False)
        .when(low.rlike(f"{BEGIN}(profit|loss|earnings|gross){END}"), False)
        .when(low.contains("income tax"), True)
        .otherwise(low.rlike(f"{BEGIN}(costs?|expenses?){END}"))
    )


def fix_expense_sign(label: Column, value: Column) -> Column:
    return F.when(is_expense_label(label) & (value > 0), -value).otherwise(value)


_NOTES, _DIGITS, _TWO = re.compile(r"[\s,]*\([A-Za-z]?\.?\d+\)", re.ASCII), re.compile(r"([A-Za-z])\d+" + END, re.ASCII), re.compile(r"\s{2,}", re.ASCII)
_NO_COST, _COST = re.compile(f"{BEGIN}(profit|loss|earnings|gross){END}"), re.compile(f"{BEGIN}(costs?|expenses?){END}")


def _is_cost(label: str) -> bool:
    low = label.lower()
    if ("income" in low and "expense" in low) or _NO_COST.search(low):
        return False
    return "income tax" in low or bool(_COST.search(low))


@lru_cache(maxsize=100_000)
def _ascii_facts(label: str | None) -> dict | None:
    """What label_facts tells of an ASCII label; None for others."""
    key = ascii_key(label)
    if key is None:
        return None
    shown = _TWO.sub(" ", _DIGITS.sub(r"\1", _NOTES.sub("", label))).strip(BLANKS)
    return {"key": key, "shown": shown, "cost": _is_cost(label), "shown_cost": _is_cost(shown)}


_FACTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("shown", T.StringType()), T.StructField("cost", T.BooleanType()), T.StructField("shown_cost", T.BooleanType())])


@F.arrow_udf(T.ArrayType(_FACTS))
def _facts(labels: pa.Array) -> pa.Array:
    d = labels.values.dictionary_encode()
    kind = pa.struct([("key", pa.string()), ("shown", pa.string()), ("cost", pa.bool_()), ("shown_cost", pa.bool_())])
    facts = pa.array([_ascii_facts(x) for x in d.dictionary.to_pylist()], kind)
    return pa.ListArray.from_arrays(labels.offsets, facts.take(d.indices))


def label_facts(labels: Column) -> Column:
    """canon_key, clean_label and is_expense_label of each label of an array, and is_expense_label of the label as shown:
    array<struct<key, shown, cost, shown_cost>>. Like canon_keys it works on a batch's distinct labels."""
    given = F.coalesce(labels, F.array().cast("array<string>"))
    one = lambda x: let(clean_label(x), lambda shown: F.struct(canon_key(x).alias("key"), shown.alias("shown"), is_expense_label(x).alias("cost"), is_expense_label(shown).alias("shown_cost")))
    return F.zip_with(given, _facts(given), lambda label, told: F.coalesce(told, one(label)))


def period_year(period: Column) -> Column:
    """The first year 19xx or 20xx in a period's label, or null."""
    return F.regexp_extract(period, "(?:19|20)[0-9]{2}", 0).try_cast("int")


def format_value(value: Column, unit: Column, decimals: Column, symbol: Column) -> Column:
    """A figure as shown: an em dash for null, grouped, with its currency (none for shares; a blank after "kr", "CHF")."""
    n = F.greatest(F.coalesce(decimals, F.lit(0)), F.lit(0))
    size = F.abs(value)
    # halves are rounded up for as many decimals as figures have; beyond that as Spark formats them
    shown = F.coalesce(*[F.when(n == d, F.format_number(F.round(size, d), d)) for d in range(7)], F.call_function("format_number", size, n))
    prefix = F.when(F.coalesce(unit, F.lit("")) == "shares", "").when(F.length(symbol) > 1, F.concat(symbol, F.lit(" "))).otherwise(symbol)
    return F.when(value.isNull(), "—").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), prefix, shown))


def currency_symbol(code: Column) -> Column:
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(symbols, code), code)


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def short_slug(name: Column) -> Column:
    first = F.get(F.split(F.lower(name), f"{BLANK}+", -1), F.lit(0))
    return F.regexp_replace(first, "[^a-z0-9]", "")
