"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import stored

#: A group with more than this part of all bytes, tokens or rows is placed by itself; all smaller ones are dealt into so
#: many lots (at least 128 a shard) by the class of their text's size, a power of two, and its hash, and a lot is placed as
#: one. Lots of short texts weigh more in rows, those of long ones in bytes, so they fill what uneven groups leave.
LOTS, CLASSES = 8192, 16
#: What an item may exceed a shard's room by, as a share of the shard's even part, before it is cut.
SLACK = 1 / 64


def words(text: Column) -> Column:
    """A text's tokens where no exact count is given: its blanks and line ends, and one."""
    return F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1


def place(sizes: np.ndarray, shards: int, whole: np.ndarray | None = None, slack: float = SLACK) -> list[list[tuple[int, float]]]:
    """Where each item goes: (shard, share of the item) pairs, one for all but the items that are cut. sizes: a row an
    item, a column for each thing to balance; whole: items that can't be cut.

    Items go in order of their largest share (ties: of all shares together, then as given). Of the shards whose residual
    capacity holds an item it goes to the one where the dot product of its shares with that capacity is highest (ties:
    the lower shard). An item that no shard holds goes where the product is highest, if it exceeds that shard's room by
    no more than `slack` of an even part or can't be cut; else it is dealt to all shards in proportion to how much of it
    each has room for.
    """
    share = sizes / np.maximum(sizes.sum(axis=0), 1)
    room = np.full((shards, sizes.shape[1]), 1 / shards)
    out: list[list[tuple[int, float]]] = [[] for _ in sizes]
    for i in np.lexsort((np.arange(len(sizes)), -share.sum(axis=1), -share.max(axis=1))).tolist():
        s = share[i]
        dot = room @ s
        fits = (room >= s - 1e-12).all(axis=1)
        k = int(np.argmax(np.where(fits, dot, -np.inf) if fits.any() else dot))
        parts = np.zeros(shards)
        parts[k] = 1.0
        if not fits.any() and not (whole is not None and whole[i]) and (s - room[k]).max() > slack / shards:
            can = np.where(s > 0, np.maximum(room, 0) / np.where(s > 0, s, 1), np.inf).min(axis=1)
            parts = can / can.sum() if can.sum() > 1e-6 else parts
        room -= parts[:, None] * s
        out[i] = [(int(k), float(parts[k])) for k in np.flatnonzero(parts)]
    return out


def shard_documents(docs: DataFrame, shards: int = 8, lots: int = LOTS, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """Shards 0 to shards - 1 for docs (doc_id, text), with bytes, tokens and rows near equal in each.

    A group is all rows of one text and stays in one shard, unless it exceeds the room of every shard: only then its rows
    are dealt out by a hash (see place; a group of one row is never cut). Groups above a lot's size are placed each, at
    most three times `lots` of them; the driver places them and the lots by their sums, whatever the input's size.

    Returns doc_id, size (UTF-8 bytes and one), text_crc32 (of no bytes for a null text), item, shard and slot (gapless
    from 0 in each shard, by item, a hash and doc_id). Null texts are one group beside that of empty ones, repeated rows
    have slots of their own, a null doc_id is like any other; other columns are not read. No rows give no rows.

    Documents are read once, for a narrow row each; repeated rows are one row with a count until the end, and an item's
    slots are numbered in pieces of about a lot's size, so neither a repeated row nor a hot group meets in one task.
    """
    spark, lots = docs.sparkSession, max(lots, 128 * shards)
    text = F.coalesce("text", F.lit(""))
    d = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        tokens(text).cast("long").alias("tokens"), F.xxhash64("text", F.octet_length("text")).alias("h"),
    )
    d = stored(d.groupBy(*d.columns).agg(F.count("*").alias("copies")))
    sums = [F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("rows")]
    total = d.agg(*sums).first()
    heavy = F.greatest(*[F.col(c) / max(1, total[c] or 0) for c in ("size", "tokens", "rows")]) > 1 / lots
    size_class = F.least(F.greatest(F.floor(F.log2(F.col("bytes"))) - 4, F.lit(0)), F.lit(CLASSES - 1))
    lot = size_class * (lots // CLASSES) + F.pmod("h", F.lit(lots // CLASSES))
    item = F.when(heavy, F.struct("h", "text_crc32")).otherwise(F.struct(lot.alias("h"), F.lit(-1).cast("long").alias("text_crc32")))
    items = d.groupBy("h", "text_crc32").agg(*sums, F.first("size").alias("bytes")).select(item.alias("item"), "size", "tokens", "rows")
    items = items.groupBy("item").agg(*[F.sum(c).alias(c) for c in ("size", "tokens", "rows")]).select("item.*", "size", "tokens", "rows").orderBy("text_crc32", "h").collect()
    parts = place(np.array([[i["size"], i["tokens"], i["rows"]] for i in items], float).reshape(-1, 3), shards, np.array([i["rows"] == 1 for i in items]))
    rows = []
    for n, (i, own) in enumerate(zip(items, parts)):
        ends = np.cumsum([share for _, share in own]).tolist()
        pieces = max(1, -(-i["rows"] * lots // max(1, total["rows"])))
        rows.append((n, i["h"], i["text_crc32"], [(e, k) for e, (k, _) in zip([*ends[:-1], 2.0], own)], pieces))
    table = spark.createDataFrame(rows, T.StructType.fromDDL("item int, h long, text_crc32 long, parts array<struct<ends:double,shard:int>>, pieces long"))
    alone, dealt = table.where("text_crc32 >= 0"), table.where("text_crc32 < 0").select(F.col("h").alias("lot"), *[F.col(c).alias(f"lot_{c}") for c in ("item", "parts", "pieces")])

    d = d.join(F.broadcast(alone), ["h", "text_crc32"], "left").withColumn("bytes", F.col("size")).withColumn("lot", lot).join(F.broadcast(dealt), "lot", "left")
    for c in ("item", "parts", "pieces"):
        d = d.withColumn(c, F.coalesce(c, f"lot_{c}"))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    at = F.pmod(F.xxhash64("doc_id", "copy", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    to = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["shard"]).otherwise(F.get(F.filter("parts", lambda p: p["ends"] > at), F.lit(0))["shard"])
    d = d.select("item", to.alias("shard"), F.pmod(F.xxhash64("doc_id", "copy"), F.col("pieces")).alias("piece"), "doc_id", "copy", "size", "text_crc32", "h")
    # about (4 + shards) * lots sums at most
    counts, start, filled = d.groupBy("item", "shard", "piece").agg(F.count("*").alias("n")).orderBy("item", "shard", "piece").collect(), [], [0] * shards
    for c in counts:
        start.append((c["item"], c["shard"], c["piece"], filled[c["shard"]]))
        filled[c["shard"]] += c["n"]
    start = spark.createDataFrame(start, T.StructType.fromDDL("item int, shard int, piece long, start long"))
    row = F.row_number().over(Window.partitionBy("item", "shard", "piece").orderBy("doc_id", "text_crc32", "size", "h", "copy"))
    d = d.withColumn("row", row).join(F.broadcast(start), ["item", "shard", "piece"])
    return d.select("doc_id", "size", "text_crc32", "item", "shard", (F.col("start") + F.col("row") - 1).alias("slot"))
