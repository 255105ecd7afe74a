"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import stored

#: Permitted sequence lengths (in characters, as a character-level model counts tokens), and what a sequence costs
#: besides its length.
CAPACITIES, BIN_COST = (2048, 4096, 8192, 16384), 64
#: Pieces that are packed together in one task.
LOT = 50_000


def best_fit(sizes: np.ndarray, capacities: tuple = CAPACITIES, bin_cost: float = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it, and its capacity, for each size (none above the largest capacity).

    Sizes go in falling order, each into the open bin with the least room that still holds it. Where none does, a bin is
    opened whose cost, its capacity and bin_cost, is least for what it can hold: this size and those still to come that
    fit beside it (ties: the larger). At last each bin shrinks to the least capacity that holds its contents.
    """
    caps = sorted(capacities)
    order = np.argsort(-sizes, kind="stable")
    left = np.append(np.cumsum(sizes[order][::-1])[::-1], 0)
    falling = -sizes[order]
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    filled: list[int] = []
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for n, i in enumerate(order.tolist()):
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for c in caps:
                if c >= size:
                    fits = max(n + 1, int(np.searchsorted(falling, size - c)))
                    cost = (c + bin_cost) / max(1, min(c, size + int(left[fits])))
                    if best is None or cost <= best[0]:
                        best = (cost, c)
            room, b = best[1], len(filled)
            filled.append(0)
        bins[i], offset[i] = b, filled[b]
        filled[b] += size
        insort(rooms, (room - size, b))
    least = np.array(caps)[np.searchsorted(caps, filled)] if filled else np.zeros(0, np.int64)
    return bins, offset, least[bins]


def pack_documents(docs: DataFrame, capacities: tuple = CAPACITIES, bin_cost: float = BIN_COST, lot: int = LOT, tokens: Callable[[Column], Column] = F.length) -> DataFrame:
    """Every document of docs (doc_id, text) in sequences: doc_id, piece, start, length, bin_id, capacity, offset.

    A text of more tokens (of the text column; characters as they are given) than the largest capacity is cut into pieces
    of it; start and length, in tokens, say what a piece holds, so with characters substring(text, start + 1, length) at
    `offset` fills sequence bin_id. Pieces are dealt out evenly, about `lot` to a task, and packed there by best_fit; only a
    task's last sequences can be emptier than they would be in one run over everything. Null and empty texts are pieces of
    length 0, pieces of equal length go by doc_id and piece, repeated rows are packed each, null doc_ids like others; other
    columns are not read. Texts are read once and not shuffled. No rows give no rows.
    """
    most = max(capacities)
    n = F.coalesce(tokens(F.col("text")), F.lit(0)).cast("int")
    d = docs.select("doc_id", n.alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("int"))))
    d = d.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("length"))
    d = stored(d)
    lots = max(1, -(-d.count() // lot))
    d = d.repartition(lots).sortWithinPartitions("length", "doc_id", "piece")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            x = pa.Table.from_batches(rows)  # ids go through as they are, nulls among them
            bins, offset, capacity = best_fit(x["length"].to_numpy().astype(np.int64), capacities, bin_cost)
            added = {"bin_id": (TaskContext.get().partitionId() << 32) + bins, "capacity": capacity.astype(np.int32), "offset": offset.astype(np.int32)}
            yield from pa.table({c: x[c] for c in x.column_names} | added).to_batches()

    return d.mapInArrow(pack, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start int, length int, bin_id long, capacity int, offset int")
