"""Repeated passages by relative Lempel-Ziv parsing of documents against indexed blocks of reference text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import BROADCAST_ROWS, bounded_batches, forget, join_hot, shuffles_removed, stored
from tallyframe.llm.textops import CHUNK, mix, slices

#: Consecutive words of a window, and of the gram that a window is found by.
WINDOW, GRAM = 35, 8
#: Words of the reference that one block indexes, and words of documents that meet it in one task.
BLOCK_WORDS, PART_WORDS = 200_000, 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of a base, and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = _BASES[which]
        out = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            x = np.full(max(n, CHUNK + 1), b)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[which] = tuple(out)
    return tuple(x[:n] for x in _powers[which])


class Runs:
    """Hashes of runs of a sequence of uint64, each from two sums over it."""

    def __init__(self, x: np.ndarray, which: int = 0):
        up, self.down = _power(which, len(x) + 1)
        self.total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * up[:-1], out=self.total[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.total[last] - self.total[first]) * self.down[first] ^ (last - first).astype(np.uint64))


def blank_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (longest runs of bytes other than 0x20 and 0x09 to 0x0D), and where each text's words start (one
    more entry than texts). Long texts are hashed in parts cut between words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    start = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=start[1:])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    at, found, lo = [], [], 0
    while lo < len(buf):
        hi = min(lo + CHUNK, len(buf))
        while hi < len(buf) and not _SPACE[buf[hi - 1]]:
            blank = np.flatnonzero(_SPACE[buf[hi : hi + CHUNK]])
            hi = hi + int(blank[0]) + 1 if len(blank) else min(hi + CHUNK, len(buf))
        part = buf[lo:hi]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[part]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at.append(first + lo)
        found.append(Runs(part.astype(np.uint64)).hashes(first, last))
        lo = hi
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.searchsorted(at, start)


def pieces(texts: list[str], window: int = WINDOW, gram: int = GRAM) -> pd.DataFrame:
    """The windows of each text by the gram that they are found by: of a window's grams the one with the least hash (ties:
    the first), so that equal windows have equal grams at equal places.

    Windows next to each other with one gram in one place make a piece: own (the text's index), h (the gram's hash), g
    (a hash of the piece's words), lo (its first window), n (its windows).
    """
    words, start = blank_words(texts)
    width = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        return pd.DataFrame({"own": [], "h": [], "g": [], "lo": [], "n": []}).astype("int64")
    grams = np.arange(len(words) - gram + 1)
    h = Runs(words).hashes(grams, grams + gram)
    best, size = grams, 1  # the first least gram of each run of `size` grams
    pick = lambda a, b: np.where(h[a] <= h[b], a, b)
    while size * 2 <= width:
        best, size = pick(best[:-size], best[size:]), size * 2
    best = pick(best[: len(best) - (width - size)], best[width - size :])[:n]
    own = np.repeat(np.arange(len(texts)), np.diff(start))[:n]
    fine = np.flatnonzero(np.arange(n) + window <= start[own + 1])
    best, own = best[fine], own[fine]
    new = np.ones(len(fine), bool)
    new[1:] = (best[1:] != best[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    lo, count = fine[at], np.diff(np.append(at, len(fine)))
    g = Runs(mix(words), 1).hashes(lo, lo + count + window - 1)
    return pd.DataFrame({"own": own[at], "h": h[best[at]].view(np.int64), "g": g.view(np.int64), "lo": lo - start[own[at]], "n": count})


def suffix_order(x: np.ndarray) -> np.ndarray:
    """The suffixes of x in order, by doubling the length that is told apart. x ends in a value that occurs once."""
    rank, width = np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (len(x) + 1)
        key[: max(0, len(x) - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        low = key[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(low[1:] != low[:-1])]) if len(x) else 0
        if not len(x) or rank[order[-1]] == len(x) - 1:
            return order
        width *= 2


class Reference:
    """A block of reference text: segments of words, each of some text from some word on, and the order of its suffixes."""

    def __init__(self, texts: list[int], starts: list[int], words: list[list[str]]):
        self.code: dict[str, int] = {}
        parts = [np.array([self.code.setdefault(w, len(self.code)) for w in x], np.int64) for x in words]
        ends = len(self.code) + 1 + np.arange(len(parts))  # one of its own for each segment, so that none runs into the next
        self.x = np.concatenate([np.append(p, e) for p, e in zip(parts, ends)]) if parts else np.zeros(0, np.int64)
        size = np.array([len(p) + 1 for p in parts], np.int64)
        self.text, self.at = np.repeat(np.array(texts, np.int64), size), np.repeat(np.array(starts, np.int64) - np.cumsum(size) + size, size) + np.arange(len(self.x))
        self.order = suffix_order(self.x)
        self.bytes = self.x.astype(">u4").tobytes()

    def encode(self, words: list[str]) -> np.ndarray:
        unknown = len(self.code)
        return np.array([self.code.get(w, unknown) for w in words], np.int64)

    def longest(self, doc: np.ndarray, raw: bytes, i: int) -> tuple[int, int]:
        """Length and place of the longest part of the reference that doc has from its word i on."""
        reach = 256
        while True:
            sought = raw[4 * i : 4 * (i + reach)]
            k = bisect_left(self.order, sought, key=lambda p: self.bytes[4 * p : 4 * p + len(sought)])
            best = (0, 0)
            for p in self.order[max(0, k - 1) : k + 1].tolist():
                n = min(reach, len(doc) - i, len(self.x) - p)
                differ = np.flatnonzero(doc[i : i + n] != self.x[p : p + n])
                best = max(best, (int(differ[0]) if len(differ) else n, p))
            if best[0] < reach or reach >= len(doc) - i:
                return best
            reach *= 8

    def factors(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(first word, words, place in the reference) of a greedy parse's factors of at least `least` words. Windows that lie
        across a factor's end are looked for by themselves: the next factor may begin with the first of them."""
        doc = self.encode(words)
        raw, i = doc.astype(">u4").tobytes(), 0
        while i + least <= len(doc):
            n, p = self.longest(doc, raw, i)
            if n >= least:
                yield i, n, p
            i += n - least + 1 if n >= least else 1

    def repeats(self, least: int) -> np.ndarray:
        """Places of the reference whose next `least` words it holds at another place too."""
        a, b = self.order[:-1], self.order[1:]
        for j in range(least):
            fine = (a + j < len(self.x)) & (b + j < len(self.x))
            a, b = a[fine], b[fine]
            same = self.x[a + j] == self.x[b + j]
            a, b = a[same], b[same]
        return np.unique(np.concatenate([a, b]))


def _merged(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Spans (row, lo, hi) of texts as the fewest that cover the same words."""
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    out: list[list[int]] = []
    for t, a, z in zip(text.tolist(), lo.tolist(), hi.tolist()):
        if out and out[-1][0] == t and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([t, a, z])
    return pd.DataFrame(out, columns=["row", "lo", "hi"]).astype("int64")


def parse_block(refs: pd.DataFrame, docs: pd.DataFrame, itself: bool, least: int) -> pd.DataFrame:
    """Spans (row, lo, hi) of words that occur elsewhere: of docs by their factors, of the reference where a factor was
    found, and where it repeats itself if `itself`."""
    ref = Reference(refs["row"].tolist(), refs["lo"].tolist(), [w.split(" ") for w in refs["words"]])
    row, lo, hi = [], [], []
    hit: set[tuple[int, int]] = set()
    for text, first, words in zip(docs["doc_row"].tolist(), docs["doc_lo"].tolist(), docs["doc_words"]):
        for i, n, p in ref.factors(words.split(" "), least):
            row.append(text)
            lo.append(first + i)
            hi.append(first + i + n)
            hit.add((p, n))
    own = ref.repeats(least) if itself else np.zeros(0, np.int64)
    p = np.concatenate([np.array([x[0] for x in hit], np.int64), own])
    n = np.concatenate([np.array([x[1] for x in hit], np.int64), np.full(len(own), least)])
    return _merged(np.concatenate([np.array(row, np.int64), ref.text[p]]), np.concatenate([np.array(lo, np.int64), ref.at[p]]), np.concatenate([np.array(hi, np.int64), ref.at[p] + n]))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for p in batches:
        texts = p["text"].tolist()
        for a, z in slices(texts):
            yield p.iloc[a:z], texts[a:z]


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """The words of texts (row, a number of its own for each; text, not null) that a window of `window` words covers whose
    words start anywhere else too: row, lo, hi (from and to, in words; spans of one row may overlap).

    A part of a text can only have a factor of a window's length in blocks of the reference that hold such a window, so
    parts go to just these. Which they are is told by hashes: windows are grouped into pieces by their gram of least hash;
    equal pieces have the text of least row as their reference; where a gram has several pieces, their windows are
    compared too. Then each part is parsed greedily against the block that holds its reference, word by word.

    Texts are met by row three times (twice here, once by the caller): stored in buckets by row they aren't shuffled for it.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, t in _texts(batches):
            x = pieces(t, window, gram)
            x["row"] = p["row"].to_numpy()[x["own"]]
            yield x[["h", "g", "row", "lo", "n"]]

    found = stored(texts.mapInPandas(cut, "h long, g long, row long, lo int, n int"))
    again = stored(found.groupBy("h").agg(F.count("*").alias("all")).where("all > 1"))
    shared = stored(join_hot(found, again, ["h"], "all").drop("all"))
    forget(found, again)
    alike = stored(shared.groupBy("h", "g").agg(F.count("*").alias("c"), F.min("row").alias("ref")))
    per_gram = stored(alike.groupBy("h").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("c") == 1, 1)).alias("single")))
    kinds = join_hot(alike, per_gram, ["h"], "kinds")
    kinds = stored(kinds.select("h", "g", "c", "ref", ((F.col("kinds") > 1) & (F.col("single") > 0)).alias("mixed")))
    forget(alike, per_gram)
    found = join_hot(shared, kinds, ["h", "g"], "c")
    look = F.col("mixed") & ((F.col("c") == 1) | (F.col("row") == F.col("ref")))
    asked = found.select("row", F.struct("lo", "n", F.when(F.col("c") > 1, F.col("ref")).otherwise(-1).alias("ref"), look.alias("look")).alias("x"))
    asked = asked.groupBy("row").agg(F.collect_list("x").alias("x"))  # of one text
    asked = stored(asked.select("row", *[F.col(f"x.{c}").alias(c) for c in ("lo", "n", "ref", "look")]), "row")
    forget(shared, kinds)

    def hash_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, t in _texts(batches):
            words, start = blank_words(t)
            one, two = Runs(words), Runs(mix(words), 1)
            row, at = [p["row"].to_numpy()[:0]], [np.zeros(0, np.int64)]
            for k, (r, lo, n, look) in enumerate(zip(p["row"], p["lo"], p["n"], p["look"])):
                lo, n = lo[look], n[look].astype(np.int64)
                at.append(np.repeat(start[k] + lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                row.append(np.full(len(at[-1]), r))
            at, row = np.concatenate(at), np.concatenate(row)
            base = start[np.searchsorted(start, at, "right") - 1]
            yield pd.DataFrame({"w": one.hashes(at, at + window).view(np.int64), "v": two.hashes(at, at + window).view(np.int64), "row": row, "pos": at - base})

    seen = stored(texts.join(asked.where(F.exists("look", lambda x: x)), "row").mapInPandas(hash_windows, "w long, v long, row long, pos int"))
    twice = stored(seen.groupBy("w", "v").agg(F.count("*").alias("c"), F.min("row").alias("ref")).where("c > 1"))
    alike = join_hot(seen, twice, ["w", "v"], "c").groupBy("row").agg(F.collect_list(F.struct("pos", "ref")).alias("x"))  # of one text
    alike = alike.select("row", F.col("x.pos").alias("pos"), F.col("x.ref").alias("pos_ref"))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of windows with one reference, as words."""
        for p in batches:
            out = []
            for row, text, lo, n, of, pos, pos_of in p[["row", "text", "lo", "n", "ref", "pos", "pos_ref"]].itertuples(index=False):
                lo, n, of = lo[of >= 0], n[of >= 0], of[of >= 0]
                if pos is not None:
                    lo, n, of = np.append(lo, pos), np.append(n, np.ones(len(pos), np.int64)), np.append(of, pos_of)
                if len(lo):
                    order = np.lexsort((lo, of))
                    of, lo, n = of[order], lo[order].astype(np.int64), n[order]
                    own = np.cumsum(np.append(0, of[1:] != of[:-1])) << 32
                    top = np.maximum.accumulate(own + lo + n)  # how far a run reaches
                    first = np.append(True, (own + lo)[1:] > top[:-1])
                    last, words = np.append(first[1:], True), text.encode("utf-8", "surrogatepass").split()
                    for ref, a, z in zip(of[first].tolist(), lo[first].tolist(), ((top - own)[last] + window - 1).tolist()):
                        out.append((ref, row, a, z - a, b" ".join(words[a:z]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["ref", "row", "lo", "n", "words"])

    cut_out = stored(texts.join(asked.drop("look"), "row").join(alike, "row", "left").mapInPandas(segments, "ref long, row long, lo int, n int, words string"))
    forget(asked, seen, twice)
    own = F.col("ref") == F.col("row")
    total = cut_out.where(own).agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    s = cut_out.withColumn("block", F.pmod(F.xxhash64("ref"), F.lit(blocks)))
    cuts = s.groupBy("block").agg(F.count("*").alias("rows"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(~own, F.col("n"))) / part_words)).cast("int").alias("cuts"))
    parts = s.join(F.broadcast(cuts), "block") if blocks <= BROADCAST_ROWS else join_hot(s, cuts, ["block"], "rows")
    docs = parts.where(~own).withColumn("part", F.pmod(F.xxhash64("row", "lo"), F.col("cuts")).cast("int"))
    refs = parts.where(own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def parse(key: tuple, ref: pd.DataFrame, doc: pd.DataFrame) -> pd.DataFrame:
        return parse_block(ref, doc, key[1] == 0, window)

    columns = ["block", "part", "row", "lo", "words"]
    docs = docs.select(*[F.col(c).alias(f"doc_{c}") for c in columns])
    both = refs.select(columns).groupBy("block", "part").cogroup(docs.groupBy("doc_block", "doc_part"))
    spans = stored(both.applyInPandas(parse, "row long, lo int, hi int"))
    forget(cut_out)
    return spans.distinct()


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Each row of docs (doc_id, text) without its repeated words: doc_id, n_words, n_removed, spans (array of lo, hi, in
    words: what is removed), kept (the other words, joined by one blank).

    Words are the longest runs of other characters than blanks (0x20, 0x09 to 0x0D), unchanged. A word goes if a window of
    `window` consecutive words that covers it starts anywhere else too, in this or another row; windows are judged on the
    texts as given. So repeated rows go from each of their copies, if they have a window at all; texts of fewer words stay
    as they are, and null and empty ones have no words and keep "". Null and repeated doc_ids are kept; other columns
    aren't read. No rows give no rows. Whole texts are parsed, however long. Rows are numbered as they are read and then
    shuffled, so docs should be read from files or stored: the order of rows from a shuffle may change if an executor is lost.
    """
    bounded_batches(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        d = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "row")  # a row's number is what was stored
        spans = repeated_spans(d.where("text is not null").select("row", "text"), window, **options)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))  # of one text

    @F.pandas_udf("n_words long, n_removed long, spans array<struct<lo:int,hi:int>>, kept string")
    def keep(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, spans):
            words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
            n, gone, kept, last = len(words), [], [], 0
            for x in found if found is not None else ():
                if gone and x["lo"] <= gone[-1]["hi"]:
                    gone[-1]["hi"] = max(gone[-1]["hi"], x["hi"])
                else:
                    gone.append({"lo": x["lo"], "hi": x["hi"]})
            for x in gone:
                kept += words[last : x["lo"]]
                last = x["hi"]
            kept += words[last:]
            out.append((n, n - len(kept), gone, b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])

    return d.join(spans, "row", "left").select("doc_id", keep("text", "spans").alias("x")).select("doc_id", "x.*")
