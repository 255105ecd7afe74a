"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of a conversation's turn tokens are cut at multiples of a stride; every span between cuts is one training
window. The system turn stands first in each window, a limited history is repeated before the new turns, and only
assistant turns that are new in a window are under its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template. No turn's escaped role or text holds "#", "<" or a bare backslash.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def _escape(x: Column, pairs) -> Column:
    for plain, mark in pairs:
        x = F.replace(x, F.lit(plain), F.lit(mark))
    return x


def _unescape(x: Column, pairs=ROLE_ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return x


def turn_tokens(text: Column) -> Column:
    """A turn's tokens where no exact count is given: a quarter of its UTF-8 bytes, and four for the template."""
    return F.ceil(F.octet_length(text) / 4) + 4


def chat_windows(turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_share: float = 0.25, tokens=turn_tokens) -> DataFrame:
    """Windows of the conversations in turns (conv_id, turn, role, text), at most `budget` tokens each.

    A conversation's first turn, if its role is "system", is its system turn. The rest of the budget is shared between
    history and new turns. A new turn belongs to the span of the stride in which its first token falls; the turn that
    runs over a cut joins that span only if all of it fits, else it has a span of its own, so only a turn (or system
    turn) that alone exceeds its share makes a window with `over_budget`. History is the up to `history_turns` turns
    before the first new one while they fit in `history_share` of the budget.

    Returns conv_id, window_no (from 0), text, loss (start from 0 and length in code points, of new assistant texts as
    escaped), n_repeated and n_new (turns), n_tokens, over_budget. Null texts and roles count as empty, rows with equal
    turn are ordered by role and text, repeated rows are turns like others, a null conv_id is one conversation; other
    columns are not read. No rows give no windows.
    """
    by = Window.partitionBy("conv_id")
    w = by.orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("size", tokens(F.col("text")).cast("long")).withColumn("pos", F.row_number().over(w))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    role, text = _escape(F.col("role"), ROLE_ESCAPES), _escape(F.col("text"), ESCAPES)
    t = t.withColumn("head", F.concat(F.lit(OPEN), role, F.lit(MIDDLE))).withColumn("body", text)
    t = t.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).withColumn("system", system)
    for name, value in (("sys_piece", F.col("piece")), ("sys_size", F.col("size"))):
        t = t.withColumn(name, F.first(F.when(F.col("system"), value)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("sys_size", F.coalesce("sys_size", F.lit(0)))
    rest = F.greatest(F.lit(budget) - F.col("sys_size"), F.lit(2))
    t = t.withColumn("kept", F.floor(rest * history_share).cast("long"))
    t = t.withColumn("stride", F.greatest(rest - F.col("kept"), F.lit(1)))
    size = F.when(F.col("system"), 0).otherwise(F.col("size"))
    t = t.withColumn("ends", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("starts", F.col("ends") - size).withColumn("cut", F.floor(F.col("starts") / F.col("stride")))
    over = F.floor((F.col("ends") - 1) / F.col("stride")) > F.col("cut")
    first = F.min("starts").over(Window.partitionBy("conv_id", "cut"))
    t = t.withColumn("span", 2 * F.col("cut") + F.when(over & (F.col("ends") - first > F.col("stride")), 1).otherwise(0))
    least = F.min(F.when(~F.col("system"), F.col("span"))).over(by)
    t = t.withColumn("span", F.when(F.col("system"), F.coalesce(least, F.lit(0))).otherwise(F.col("span")))
    begins = F.coalesce(F.lag("span").over(w) != F.col("span"), F.lit(True))
    before, count, used = F.lit(""), F.lit(0), F.lit(0)
    for k in range(1, history_turns + 1):
        used = used + F.lag("size", k).over(w)
        fits = F.coalesce((used <= F.col("kept")) & ~F.lag("system", k).over(w), F.lit(False))
        before = F.concat(F.when(fits, F.lag("piece", k).over(w)).otherwise(""), before)
        count = count + F.when(fits, 1).otherwise(0)
        t = t.withColumn(f"used_{k}", F.when(fits, used).otherwise(0))
    t = t.withColumn("begins", begins)
    repeat_system = F.col("begins") & F.col("sys_piece").isNotNull() & ~F.col("system")
    t = t.withColumn("before", F.when(F.col("begins"), F.concat(F.when(repeat_system, F.col("sys_piece")).otherwise(""), before)))
    t = t.withColumn("n_before", F.when(F.col("begins"), count + F.when(repeat_system, 1).otherwise(0)))
    t = t.withColumn("t_before", F.when(F.col("begins"), F.greatest(*[F.col(f"used_{k}") for k in range(1, history_turns + 1)], F.lit(0), F.lit(0)) + F.when(repeat_system, F.col("sys_size")).otherwise(0)))
    inside = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("at", F.sum(F.length("piece")).over(inside) - F.length("piece") + F.length("head"))
    one = F.struct("pos", "piece", "at", F.length("body").alias("n"), (F.col("role") == "assistant").alias("target"))
    g = t.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(one)).alias("new"), F.max("before").alias("before"), F.max("n_before").alias("n_repeated"),
        F.count("*").alias("n_new"), (F.sum("size") + F.max("t_before")).alias("n_tokens"),
    )
    shift = F.length("before")
    return g.select(
        "conv_id",
        (F.row_number().over(by.orderBy("span")) - 1).alias("window_no"),
        F.concat("before", F.array_join(F.transform("new", lambda x: x["piece"]), "")).alias("text"),
        F.transform(F.filter("new", lambda x: x["target"]), lambda x: F.struct((shift + x["at"]).alias("start"), x["n"].alias("length"))).alias("loss"),
        "n_repeated",
        "n_new",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window: turns (role, text) that are new in it, and loss_text, all text under its mask; both read from the
    formatted text and unescaped."""
    parts = F.slice(F.split("text", CLOSE, -1), F.col("n_repeated") + 1, F.col("n_new").cast("int"))

    def turn(p: Column) -> Column:
        colon = F.instr(p, MIDDLE)
        return F.struct(
            _unescape(F.substring(p, len(OPEN) + 1, colon - len(OPEN) - 1)).alias("role"),
            _unescape(F.substring(p, colon + len(MIDDLE), F.length(p))).alias("text"),
        )

    masked = F.array_join(F.transform("loss", lambda x: F.substring(F.col("text"), x["start"] + 1, x["length"])), "")
    return windows.select("conv_id", "window_no", F.transform(parts, turn).alias("turns"), _unescape(masked, ESCAPES).alias("loss_text"), F.length("text").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation the digests of what its windows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(windows)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    g = back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window_no", lines.alias("lines"), "loss_text"))).alias("all"),
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    whole = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(whole("lines"), 256).alias("turns_sha256"), F.length(whole("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )
