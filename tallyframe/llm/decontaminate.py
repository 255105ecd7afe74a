"""Benchmark decontamination by the q-gram lemma: shared q-grams in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import bounded_batches, small, stored
from tallyframe.llm.textops import CHUNK, mix, slices

#: Length of a q-gram in characters, and edits allowed as a share of an item's length.
Q, EDITS = 12, 0.05
#: Benchmark characters that one broadcast index may hold; a larger benchmark is searched for in several passes.
BLOCK_CHARS = 4_000_000
#: Where an item and a text share q-grams at more pairs of places than this for each character, they repeat themselves so
#: much that all diagonals would be kept: such parts of a text are aligned without them.
DENSE = 4
#: Characters of a text whose q-grams are looked up at once.
WINDOW = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_ASCII = np.array([chr(c).isalnum() for c in range(128)])


@dataclass
class BenchmarkIndex:
    ids: list  # item ids
    chars: list[np.ndarray]  # normalised characters of each item
    edits: np.ndarray  # most edits of each item
    bound: np.ndarray  # q-grams that a region within those edits must share with it (0: it is shorter than a q-gram)
    grams: np.ndarray  # sorted distinct q-gram hashes
    first: np.ndarray  # where each hash's (hash, item) pairs begin
    item: np.ndarray  # of each pair: item, and where its places begin
    at: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length of the items shorter than a q-gram: sorted hashes, items


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _kept(raw: str, before: bool, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Normalised characters of raw and their places in it; before: whether a letter or digit comes right before it; ends:
    where in raw a text ends, at a 0."""
    code = np.frombuffer(_lower(raw).encode("utf-32-le", "surrogatepass"), "<u4")
    word = (code >= 128) & ((code < 0x2000) | (code > 0x206F)) & (code != 0xA0) & (code != 0xAB) & (code != 0xBB)
    low = code < 128
    word[low] = _ASCII[code[low]]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[:1] |= before
    out = np.where(word, code, np.uint32(32))
    if ends is not None:
        keep[ends], out[ends] = True, 0
    at = np.flatnonzero(keep)
    return out[at], at, bool(word[-1]) if len(word) else before


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' characters in lower case, each run of others than letters and digits as one blank (none before the
    first word), and a 0 after each text. Also each character's text, its place in that text, and where texts begin. A
    long text is unpacked part by part; what stays is 12 bytes a character."""
    code, own, at = [], [], []
    for first, last in slices(texts, CHUNK):
        if last - first > 1 or len(texts[first]) <= CHUNK:  # short texts at once, with a 0 after each
            size = np.array([len(t) + 1 for t in texts[first:last]])
            c, a, _ = _kept("\0".join(texts[first:last]) + "\0", False, np.cumsum(size) - 1)
            of = np.repeat(np.arange(first, last, dtype=np.int32), size)[a]
            parts = [(c, of, a - (np.cumsum(size) - size)[of - first])]
        else:
            parts, before = [], False
            for lo in range(0, len(texts[first]), CHUNK):
                c, a, before = _kept(texts[first][lo : lo + CHUNK], before)
                parts.append((c, np.full(len(c), first, np.int32), a + lo))
            parts.append((np.zeros(1, np.uint32), np.full(1, first, np.int32), np.full(1, len(texts[first]))))
        for c, of, a in parts:
            code.append(c)
            own.append(of)
            at.append(a.astype(np.int32))
    own = np.concatenate(own) if own else np.zeros(0, np.int32)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(code, np.uint32), own, join(at, np.int32), np.searchsorted(own, np.arange(len(texts)))


def qgram_hashes(code: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each place on (by doubling: about log2 q steps)."""
    x, width, done, total = code.astype(np.uint64) + np.uint64(1), 1, 0, None
    power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    while True:
        if q & width:
            n = len(code) - done - width + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            total = x[:n].copy() if total is None else total[:n] * power(width) + x[done : done + n]
            done += width
        if done == q:
            return mix(total)
        x = x[:-width] * power(width) + x[width:] if len(x) > width else x[:0]
        width *= 2


def build_index(items: list[tuple], q: int = Q, edits: float = EDITS) -> BenchmarkIndex:
    """Items (id, text) of the benchmark; those without a letter or digit are left out. An item's edits are lowered so far
    that the lemma's bound, m + 1 - q * (edits + 1), is 1 at least; one shorter than a q-gram is looked for as it is."""
    ids, chars, most, bound, gram, item, place, short = [], [], [], [], [], [], [], {}
    for name, text in items:
        c = normalise([text or ""])[0][:-1]
        c = c[:-1] if len(c) and c[-1] == 32 else c
        if not len(c):
            continue
        k = max(0, min(int(edits * len(c)), len(c) // q - 1))
        h = qgram_hashes(c, q)
        if len(c) < q:
            short.setdefault(len(c), []).append((qgram_hashes(c, len(c))[0], len(ids)))
        item.append(np.full(len(h), len(ids), np.int32))
        place.append(np.arange(len(h), dtype=np.int32))
        gram.append(h)
        ids.append(name)
        chars.append(c)
        most.append(k)
        bound.append(len(c) + 1 - q * (k + 1) if len(c) >= q else 0)
    gram, item, place = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((gram, np.uint64), (item, np.int32), (place, np.int32)))
    order = np.lexsort((place, item, gram))
    gram, item, place = gram[order], item[order], place[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
    at = np.flatnonzero(new)
    grams, first = np.unique(gram[at], return_index=True)
    tables = {n: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(found)), (np.uint64, np.int64))) for n, found in short.items()}
    return BenchmarkIndex(ids, chars, np.array(most, np.int64), np.array(bound, np.int64), grams, np.append(first, len(at)), item[at].astype(np.int64), np.append(at, len(gram)), place, tables)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … count[0] of them, then those of start[1], and so on."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def distances(item: np.ndarray, text: np.ndarray, most: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The least edits (most + 1 for more than most) that make the item a part of text, for each place where that part may
    end. Only diagonals of text are walked along on which the item can lie. anchored: the part begins text."""
    width = len(text) - len(item) + 2 * most + 1
    if width <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    none = np.full(most, 0xFFFFFFFF, np.uint32)  # a blank margin: to lie there costs an edit a character
    pad = np.concatenate([none, text, none])
    step = np.arange(width, dtype=np.int32)
    row = np.where(step < most, most + 1, step - most).astype(np.int32) if anchored else np.zeros(width, np.int32)
    for i, c in enumerate(item):
        new = row + (pad[i : i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = (np.minimum.accumulate(new - step) + step).astype(np.int32) if most else new
        if row.min() > most:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
    end = len(item) - most + step.astype(np.int64)
    inside = (end >= 0) & (end <= len(text))
    return np.minimum(row[inside], most + 1), end[inside]


def align(item: np.ndarray, text: np.ndarray, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """The least edits (most at most) that make the item a part of text, and where the first such part ends, or None."""
    edits, end = distances(item, text, most, anchored)
    if not len(edits) or edits.min() > most:
        return None
    d = int(np.argmin(edits))
    return int(edits[d]), int(end[d])


def _between(item: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """Finds (start, end, edits) in a text from the left: the first place where the item may end within `most` edits, or
    of the next 2 * most places the first with fewest edits; then the same in what follows."""
    pos, reach = 0, len(item) + most
    size = 4 * reach
    while len(text) - pos >= len(item) - most:
        part = text[pos : pos + size]
        edits, end = distances(item, part, most)
        good = np.flatnonzero(edits <= most)
        last = pos + size >= len(text)
        if not len(good):
            if last:
                return
            pos, size = pos + size - reach, min(2 * size, max(1 << 18, 4 * reach))
            continue
        j = int(end[good[0]])
        if j + 2 * most > len(part) and not last:
            pos, size = pos + max(0, j - reach), 4 * reach
            continue
        near = good[end[good] <= j + 2 * most]
        best = near[np.argmin(edits[near])]
        j, e = int(end[best]), int(edits[best])
        back = align(item[::-1], part[max(0, j - reach) : j][::-1], e, anchored=True)
        yield pos + j - back[1], pos + j, e
        pos, size = pos + j, 4 * reach


def finds(item: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of an item in a text, none overlapping: exact ones first, from the left, then between them
    others (see _between)."""
    raw, one, exact, at = text.tobytes(), item.tobytes(), [], 0
    while (at := raw.find(one, at)) >= 0:
        if at % 4:
            at += 1
        else:
            exact.append((at // 4, at // 4 + len(item), 0))
            at += len(one)
    if not most:
        return exact
    out, lo = list(exact), 0
    for start, end, _ in [*exact, (len(text), len(text), 0)]:
        out += [(lo + a, lo + z, e) for a, z, e in _between(item, text[lo:start], most)]
        lo = end
    return sorted(out)


def _regions(code: np.ndarray, lo: int, hi: int, index: BenchmarkIndex, bitmap: np.ndarray, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Where items may lie in code[lo:hi]: (item, from, to) arrays; the region may go beyond a text's ends."""
    h = qgram_hashes(code[lo:hi], q)
    hit = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(hit):
        return
    g = np.minimum(np.searchsorted(index.grams, h[hit]), len(index.grams) - 1)
    same = index.grams[g] == h[hit]
    hit, g = hit[same] + lo, g[same]
    count = index.first[g + 1] - index.first[g]
    pair = _ranges(index.first[g], count)
    pos, item = np.repeat(hit, count), index.item[pair]
    times = index.at[pair + 1] - index.at[pair]
    reach = np.array([len(c) for c in index.chars], np.int64) + index.edits
    # parts of the text, as long as the item's regions, where they share too many pairs of places to list them
    bucket = pos // reach[item]
    key, back, hits = np.unique(item << 40 | bucket, return_inverse=True, return_counts=True)
    near = hits.astype(np.int64)
    follows = key[1:] == key[:-1] + 1
    near[1:][follows] += hits[:-1][follows]
    near[:-1][follows] += hits[1:][follows]
    dense = np.bincount(back, times, len(key)) > DENSE * reach[key >> 40]
    d = np.flatnonzero(dense & (near >= index.bound[key >> 40]))
    i, b = key[d] >> 40, key[d] & ((1 << 40) - 1)
    yield i, (b - 1) * reach[i], (b + 2) * reach[i]
    keep = ~dense[back]
    pos, item, pair, times = pos[keep], item[keep], pair[keep], times[keep]
    place = index.place[_ranges(index.at[pair], times)].astype(np.int64)
    pos, item = np.repeat(pos, times), np.repeat(item, times)
    wide = index.edits[item] + 1
    band = (pos - place + len(code)) // wide  # of diagonals, all above 0
    key = np.concatenate([item << 40 | band, item << 40 | (band - 1)])  # bands of two widths overlap by one
    uniq, back, n = np.unique(key, return_inverse=True, return_counts=True)
    kept = np.flatnonzero((n >= index.bound[uniq >> 40])[back])
    both = np.unique(back[kept] << 32 | np.concatenate([place, place])[kept]) >> 32  # each q-gram of an item counts once
    b, n = np.unique(both, return_counts=True)
    b = uniq[b[n >= index.bound[uniq[b] >> 40]]]
    i, diagonal = b >> 40, (b & ((1 << 40) - 1)) * (index.edits[b >> 40] + 1) - len(code)
    yield i, diagonal - index.edits[i], diagonal + 2 * (index.edits[i] + 1) + reach[i]


def find_leaks(texts: list[str], index: BenchmarkIndex, bitmap: np.ndarray, q: int = Q) -> list[tuple]:
    """(text's index, item's index, start, end, edits) of each benchmark item found in the texts; start and end are
    characters of the text as given."""
    code, own, at, begin = normalise(texts)
    stop = np.append(begin[1:], len(code)) - 1
    out, found = [], []
    if len(index.grams):
        reach = int(max(len(c) + k for c, k in zip(index.chars, index.edits)))
        window = max(WINDOW, 4 * reach)
        for lo in range(0, len(code), window):
            found += _regions(code, lo, min(len(code), lo + window + 2 * reach + q), index, bitmap, q)
    if found:
        item, lo, hi = (np.concatenate(x) for x in zip(*found))
        lo, hi = np.maximum(lo, 0), np.minimum(hi, len(code))
        # a region may touch several texts: its part in each
        first, last = own[np.minimum(lo, len(own) - 1)], own[np.maximum(hi - 1, 0)]
        n = np.maximum(last - first + 1, 0)
        t, of = _ranges(first.astype(np.int64), n.astype(np.int64)), np.repeat(np.arange(len(item)), n)
        item, lo, hi = item[of], np.maximum(lo[of], begin[t]), np.minimum(hi[of], stop[t])
        order = np.lexsort((lo, item, t))
        t, item, lo, hi = t[order], item[order], lo[order], hi[order]
        r = 0
        while r < len(t):  # overlapping regions of one item and text are one
            text, i, a, z, r = int(t[r]), int(item[r]), int(lo[r]), int(hi[r]), r + 1
            while r < len(t) and t[r] == text and item[r] == i and lo[r] <= z:
                z, r = max(z, int(hi[r])), r + 1
            for s, e, edits in finds(index.chars[i], code[a:z], int(index.edits[i])):
                out.append((text, i, int(at[a + s]), int(at[a + e - 1]) + 1, edits))
    for n, (hashes, items) in index.short.items():
        h = qgram_hashes(code, n)
        g = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = np.flatnonzero(hashes[g] == h)
        before, after = code[hit - 1], code[np.minimum(hit + n, len(code) - 1)]
        hit = hit[((hit == begin[own[hit]]) | (before == 32)) & ((after == 32) | (after == 0))]
        for p in hit.tolist():
            for j in range(int(np.searchsorted(hashes, h[p])), int(np.searchsorted(hashes, h[p], "right"))):
                if (code[p : p + n] == index.chars[items[j]]).all():
                    out.append((int(own[p]), int(items[j]), int(at[p]), int(at[p + n - 1]) + 1, 0))
    out.sort()
    kept = out[:1]
    for x in out[1:]:  # of a short item's finds that overlap the first counts
        if x[:2] != kept[-1][:2] or x[2] >= kept[-1][3]:
            kept.append(x)
    return kept


def leaks_in(index: BenchmarkIndex, text: Column, id_type: str, q: int = Q) -> Column:
    """array<struct(item_id, start, end, edits)> of the benchmark items in each whole text."""

    @F.pandas_udf(f"array<struct<item_id:{id_type},start:int,end:int,edits:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(index.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            found: list[list] = [[] for _ in texts]
            for lo, hi in slices(texts):
                for t, i, *rest in find_leaks(texts[lo:hi], index, bitmap, q):
                    found[lo + t].append(dict(zip(("item_id", "start", "end", "edits"), (index.ids[i], *rest))))
            yield pd.Series(found)

    return find(text)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, buckets: int = 256) -> DataFrame:
    """The distinct texts of the benchmark (item_id, text) and the block of each by running length: entry (a digest of
    the text), text, block. A block has block_chars characters and at most one text more; the driver adds up `buckets` sums."""
    b = benchmark.where("text is not null").select("text").distinct().select(F.md5("text").alias("entry"), "text", F.length("text").cast("long").alias("n"))
    b = stored(b.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets))))
    sums = {r.bucket: r.n for r in b.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    starts = np.cumsum([0, *[sums.get(k, 0) for k in range(buckets)]])[:-1].tolist()
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("bucket").cast("int"))
    here = F.sum("n").over(Window.partitionBy("bucket").orderBy("entry")) - F.col("n")
    return stored(b.select("entry", "text", F.floor((start + here) / block_chars).alias("block")))


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> Iterator[tuple[bool, BenchmarkIndex]]:
    """The distinct texts of the benchmark as one index after the other (its ids are their digests), and whether there
    are several. Blocks in which no text has a letter or digit are left out."""
    b = blocks(benchmark, block_chars)
    some = sorted(r.block for r in b.select("block").distinct().collect())
    for k in some:
        index = build_index([tuple(r) for r in b.where(F.col("block") == k).select("entry", "text").orderBy("entry").collect()], **options)
        if index.ids:
            yield len(some) > 1, index


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """Where docs (doc_id, text) hold items of benchmark (item_id, text): doc_id, item_id, start, end, edits.

    Texts are compared in lower case with runs of other characters than letters and digits as one blank. A region holds
    an item if at most `edits` of the item's characters (a share; less for short items, see build_index) are changed,
    dropped or added; an item shorter than a q-gram must be there as whole words. Finds of one item don't overlap (see
    finds). None is missed: a region within k edits shares the lemma's number of q-grams with the item on diagonals that
    some band holds; where text and item only repeat themselves, the bands give way to alignment of the whole part.

    Whole texts are searched, long ones in parts; null and empty ones hold nothing, nor do null items and such without a
    letter or digit. Items of equal text are each found, repeated rows of docs give repeated results, repeated rows of
    the benchmark count once; other columns are not read. An empty benchmark or no docs give no rows. An index holds each
    text once, whatever number of items have it. A benchmark of more than block_chars is searched for block by block, each in a
    pass of its own whose finds are stored, so one index is in memory at a time.
    """
    bounded_batches(docs.sparkSession)
    found, named = None, stored(benchmark.where("text is not null").select(F.md5("text").alias("entry"), "item_id").distinct())
    for several, index in indexes(benchmark, block_chars, **options):
        one = docs.select("doc_id", F.explode(leaks_in(index, F.col("text"), "string")).alias("x")).select("doc_id", "x.*").withColumnRenamed("item_id", "entry")
        one = stored(one) if several else one
        found = one if found is None else found.union(one)
    if found is None:
        kind = named.schema["item_id"].dataType
        return docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"), *[F.lit(0).alias(c) for c in ("start", "end", "edits")]).where("false")
    return found.join(small(named, named.count()), "entry").select("doc_id", "item_id", "start", "end", "edits")


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """The rows of docs in whose text decontaminate finds nothing, with all their columns."""
    bounded_batches(docs.sparkSession)
    for several, index in indexes(benchmark, block_chars, **options):
        docs = docs.where(F.size(leaks_in(index, F.col("text"), "string")) == 0)
        docs = stored(docs) if several else docs
    return docs
