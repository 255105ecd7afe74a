"""Language ID by nearest centroid: TF-IDF vectors of byte n-grams against several centroids per language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textops
from tallyframe.llm.shared import bounded_batches, first_by_hash, stored
from tallyframe.llm.textops import slices

#: Vector positions: n-grams of 1 to 3 bytes (lower case; runs of non-letters are one blank) are hashed into so many.
BINS = 4096
#: Labelled texts to fit on at most, of all languages together and of one language.
FIT_ROWS, FIT_PER_LANGUAGE = 4000, 500
#: Classes of length end before so many counted bytes (the last has no end); characters of the pieces that are cut from
#: each text to fit on, so that classes of short texts are known too.
LENGTHS, PIECES = 2 ** np.arange(3, 13), (6, 12, 24, 48, 96, 192, 384)
#: What share of the texts of a class stays below the cosine that its least cosine is set by, where pieces are in the class
#: (they are often of a key, a table or a licence, and so less like their language than whole texts) and where not.
PIECE_SHARE, WHOLE_SHARE = 0.05, 0.01
#: A centroid of a smaller share of its language's texts is left out: such are texts labelled wrongly.
LEAST_SHARE = 0.01
LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    least: np.ndarray  # cosine below which a centroid rejects (centroids x classes of length)


def _ngram_counts(raw: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    own = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    letter = _LETTER_BYTE[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a letter stays, as a blank
    keep[np.cumsum(size) - size] = True  # each text's first blank, whatever stands before it
    c, own = np.where(letter, buf, np.uint8(32))[keep], own[keep]
    total = np.zeros(len(raw) * BINS, np.int64)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        code = np.full(len(c) - n + 1, n, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) + c[j : len(c) - n + 1 + j]
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        same = own[: len(code)] == own[n - 1 :]
        total += np.bincount((own[: len(code)].astype(np.int64) * BINS + code)[same], minlength=len(total))
    return total.reshape(len(raw), BINS)


def _kept_end(raw: bytes) -> bytes:
    """The last two bytes that count in raw, which begins with a blank."""
    tail = re.sub(rb"[^a-z\x80-\xff]+", b" ", raw[-64:])
    return tail[-2:] if len(tail) > 2 else re.sub(rb"[^a-z\x80-\xff]+", b" ", raw)[-2:]


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts x BINS) of the hashed n-grams of whole texts. A text of more than CHUNK characters is counted in parts
    that begin with the last two bytes of what came before, so only a part of it is unpacked at a time."""
    total = np.zeros((len(texts), BINS), np.int64)
    short = [i for i, t in enumerate(texts) if len(t) <= textops.CHUNK]
    if short:
        total[short] = _ngram_counts([b" " + texts[i].lower().encode("utf-8", "replace") + b" " for i in short])
    for i, t in enumerate(texts):
        if len(t) > textops.CHUNK:
            before = b" "
            for lo in range(0, len(t), textops.CHUNK):
                part = before + t[lo : lo + textops.CHUNK].lower().encode("utf-8", "replace") + b" " * (lo + textops.CHUNK >= len(t))
                total[i] += _ngram_counts([part])[0]
                if lo:
                    total[i] -= _ngram_counts([before])[0]
                before = _kept_end(part)
    return total


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: at most k unit centroids, started from far apart rows."""
    at = [0]
    while len(at) < min(k, len(x)):
        nearest = (x @ x[at].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        at.append(int(np.argmin(nearest)))
    c = x[at]
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[to == j].mean(axis=0) if (to == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.digitize(counts.sum(axis=1) // 3, LENGTHS)


def pieces(text: str) -> list[str]:
    """A part of each length of PIECES that is shorter than the text, from a place that a hash of the text chooses."""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    return [text[at % (len(text) - n) :][:n] for n in PIECES if n < len(text)]


def _sparse(texts: pd.Series) -> pd.DataFrame:
    """For each text where its counts are not 0, and how often they occur (65,535 at most)."""
    at, times = [], []
    for lo, hi in slices(list(texts)):
        for counts in ngram_counts(list(texts[lo:hi])):
            where = np.flatnonzero(counts)
            at.append(where.astype(np.uint16).tobytes())
            times.append(np.minimum(counts[where], 65535).astype(np.uint16).tobytes())
    return pd.DataFrame({"at": at, "times": times})


def _centroids(rows: list[tuple], per_language: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The weights of positions, and each language's centroids; only one language's vectors are unpacked at a time."""
    held = np.zeros(BINS, np.int64)
    for _, at, _ in rows:
        held[np.frombuffer(at, np.uint16)] += 1
    idf = np.log((1 + len(rows)) / (1 + held)).astype(np.float32) + np.float32(1)
    out = {}
    for name in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == name]
        counts = np.zeros((len(own), BINS), np.float32)
        for x, (_, at, times) in zip(counts, own):
            x[np.frombuffer(at, np.uint16)] = np.frombuffer(times, np.uint16)
        x = unit_vectors(counts, idf)
        c = cluster(x, per_language)
        size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        out[str(name)] = c[size >= min(size.max(), LEAST_SHARE * len(x))]
    return idf, out


def _held_against(halves: list[tuple]):
    """The cosines (class of length, cosine) of a text and its pieces to its language's centroids as the other half of the
    texts gave them, without those that are nearer to another language."""

    @F.pandas_udf("array<struct<class:int,cosine:double>>")
    def near(text: pd.Series, lang: pd.Series, half: pd.Series) -> pd.Series:
        out = []
        for t, name, k in zip(text, lang, half):
            idf, learnt = halves[k] if name in halves[k][1] else halves[2]
            counts = ngram_counts([t, *pieces(t)])
            counts = counts[counts.any(axis=1)]
            v = unit_vectors(counts, idf)
            cos = np.stack([(v @ c.T).max(axis=1) for c in learnt.values()])
            own = list(learnt).index(name)
            mine = np.argmax(cos, axis=0) == own
            out.append([{"class": int(j), "cosine": float(x)} for j, x in zip(length_class(counts)[mine], cos[own][mine])])
        return pd.Series(out)

    return near


def fit_language(docs: DataFrame, per_language: int = 4, fit_rows: int = FIT_ROWS, fit_per_language: int = FIT_PER_LANGUAGE, slack: float = 0.8) -> LanguageModel:
    """Centroids from docs (doc_id, text, lang): up to fit_per_language labelled texts of each language, fit_rows in all,
    the first by a hash of doc_id (chosen without reading texts; of repeated ids one text). Rows without a letter, doc_id
    or lang are left out.

    Each language's vectors are clustered into `per_language` centroids, of which those of too few texts are left out. A
    centroid rejects what is further from it than `slack` times the cosine that one in a hundred of its language's texts
    of that class of length stays below (one in twenty where pieces count). These cosines are those of the texts of
    either half, and of pieces of them, to the centroids learnt from the other half, without what is nearer to another
    language and so judged by that one's cosines. A class that none of them is of takes the next shorter one's cosine;
    no class has a higher one than a longer class.

    The chosen texts are stored; the driver gets their counts where not 0 (4 bytes each, 4,096 a text at most) and, from a
    second pass over them, a few quantiles.
    """
    bounded_batches(docs.sparkSession)
    chosen = first_by_hash(docs, "lang", fit_per_language).orderBy("order", "lang", "doc_id").limit(fit_rows).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).where(F.col("text").rlike("\\p{L}"))
    texts = stored(texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")))
    sparse = texts.select("lang", "half", F.pandas_udf(_sparse, "at binary, times binary")("text").alias("v"))
    rows = [(r.half, (r.lang, bytes(r.at), bytes(r.times))) for r in sparse.select("lang", "half", "v.*").orderBy("lang", "at", "times").collect()]
    classes = len(LENGTHS) + 1
    if not rows:
        return LanguageModel([], np.zeros((0, BINS), np.float32), np.ones(BINS, np.float32), np.zeros((0, classes)))
    every = _centroids([r for _, r in rows], per_language)
    halves = [_centroids(x, per_language) if (x := [r for h, r in rows if h != k]) else every for k in (0, 1)]
    shares = F.percentile("x.cosine", F.array(F.lit(PIECE_SHARE), F.lit(WHOLE_SHARE)))
    cosines = texts.select("lang", F.explode(_held_against([*halves, every])("text", "lang", "half")).alias("x")).groupBy("lang", "x.class").agg(shares.alias("q"))
    known = {(r["lang"], r["class"]): r["q"] for r in cosines.collect()}
    idf, own = every
    least, short = [], int(np.digitize(max(PIECES), LENGTHS))
    for name, c in own.items():
        q = []
        for j in range(classes):
            q.append(known[name, j][0 if j <= short else 1] if (name, j) in known else q[-1] if q else 0.0)
        least += [slack * np.minimum.accumulate(q[::-1])[::-1]] * len(c)
    return LanguageModel([name for name, c in own.items() for _ in c], np.concatenate(list(own.values())), idf, np.array(least))


def detect_language(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of each whole text.

    lang_pred is the language of the centroid with the highest cosine (ties: the first in order of name), score that
    cosine from 0 to 1, rejected whether it is too far from that centroid. A text that is null or without a letter is
    "und", 0 and rejected, as is everything under a model that learnt from no rows. Of a few dozen letters little can be
    told, so short texts are seldom rejected.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) and LETTER.search(t) else None for t in batch]
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            has = [i for i, t in enumerate(texts) if t is not None and model.languages]
            for lo, hi in slices([texts[i] for i in has]):
                for a in range(lo, hi, 512):
                    at = has[a : min(a + 512, hi)]
                    counts = ngram_counts([texts[i] for i in at])
                    cos = unit_vectors(counts, model.idf) @ model.centroids.T
                    best = np.argmax(cos, axis=1)
                    value = cos[np.arange(len(at)), best]
                    score[at], far[at] = np.clip(value, 0, 1), value < model.least[best, length_class(counts)]
                    for i, b in zip(at, best):
                        lang[i] = model.languages[b]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": far})

    return detect(text)
