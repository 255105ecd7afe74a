"""A toxicity classifier that is held to the same score when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import bounded_batches, first_by_hash, stored
from tallyframe.llm.textops import slices, word_hashes

#: Words are hashed into so many features; a feature is whether a text holds such a word.
BINS = 1 << 18
#: Labelled texts of one label to fit on at most.
FIT_PER_LABEL = 5000
#: Features of all texts to fit on together at most (4 bytes each on the driver).
FIT_FEATURES = 8_000_000
#: Sentences with identity terms that one text to fit on gives counterfactuals for at most.
PAIRS_PER_TEXT = 20
#: Identity terms (fixed values): a term may be swapped for any other of its line.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["woman", "man"],
    ["women", "men"],
    ["black", "white", "asian", "latino", "arab"],
    ["immigrants", "refugees", "locals"],
    ["african", "american", "european", "mexican", "chinese"],
    ["deaf", "blind", "disabled"],
    ["elderly", "young"],
]
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted bins with a weight
    weights: np.ndarray
    bias: float


def bins_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    h, start = word_hashes(texts)
    b = (h % np.uint64(BINS)).astype(np.int64)
    return [np.unique(b[lo:hi]) for lo, hi in zip(start[:-1], start[1:])]


def swapped(text: str, terms: list[list[str]] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Each sentence that holds an identity term, with each counterfactual: all terms of one line swapped for the next."""
    nexts = {t: line[(i + 1) % len(line)] for line in terms for i, t in enumerate(line)}
    found = re.compile(r"\b(" + "|".join(map(re.escape, nexts)) + r")\b", re.IGNORECASE)
    out = []
    for m in _SENTENCE.finditer(text) if found.search(text) else ():
        other = found.sub(lambda x: nexts[x[0].lower()], m[0])
        if other != m[0]:
            out.append((m[0], other))
    return out


class _Rows:
    """Sets of features (one after the other, and where each set begins) as columns of those that are used."""

    def __init__(self, sets: list[np.ndarray], used: np.ndarray):
        at = np.full(BINS, -1, np.int32)
        at[used] = np.arange(len(used))
        kept = [c[c >= 0] for c in (at[x] for x in sets)]
        self.n, self.width = len(sets), len(used)
        self.col = np.concatenate([*kept, np.zeros(0, np.int32)])
        self.start = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(c) for c in kept], out=self.start[1:])

    def parts(self):
        """Rows (from, to), their features, and each feature's row counted from the first: some hundred thousand at a time."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + (1 << 18), "right")) - 1)
            yield lo, hi, self.col[self.start[lo] : self.start[hi]], np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))
            lo = hi

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(own, w[col], hi - lo) for lo, hi, col, own in self.parts()] or [np.zeros(0)])

    def spread(self, r: np.ndarray) -> np.ndarray:
        return sum((np.bincount(col, r[lo:hi][own], self.width) for lo, hi, col, own in self.parts()), np.zeros(self.width))


def train(features: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], lam: float = 5.0, l1: float = 5e-5, least: int = 3, rounds: int = 250) -> ToxicityModel:
    """Logistic regression with weights per row, an L1 penalty, and lam times the mean squared change of the linear
    score over counterfactual pairs; accelerated proximal gradient. Features in fewer than `least` rows are left out."""
    n, count = len(features), np.zeros(BINS, np.int64)
    for f in features:
        count[f] += 1
    used = np.flatnonzero(count >= least)
    if not n or labels.min() == labels.max():
        rate = float(np.average(labels, weights=weights)) if n else 0.0
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    x, a, b = _Rows(features, used), _Rows([p[0] for p in pairs], used), _Rows([p[1] for p in pairs], used)
    share = weights / weights.sum()
    # a step per feature: its diagonal curvature, times the most features that one row shares out
    size = np.sqrt(max(1, np.diff(x.start).max()))
    curve = 0.25 * x.spread(share) * size + 1e-4
    if len(pairs):
        curve += 2 * lam / len(pairs) * (a.spread(np.ones(a.n)) + b.spread(np.ones(b.n))) * 4
    mean = 2 * lam / max(1, len(pairs))

    def loss(z, change):
        return float(share @ (np.logaddexp(0, z) - z * labels) + mean / 2 * (change @ change))

    w, bias, t, scale = np.zeros(len(used)), float(np.log(share @ labels / (1 - share @ labels))), 1.0, 1.0
    z, change = np.full(n, bias), np.zeros(len(pairs))  # of the rows and pairs under w
    wy, by, zy, cy = w, bias, z, change
    for _ in range(rounds):
        r = share * (1 / (1 + np.exp(-zy)) - labels)
        g = x.spread(r) + (mean * (a.spread(cy) - b.spread(cy)) if len(pairs) else 0)
        fy, gb = loss(zy, cy), float(r.sum())
        while True:  # a step as long as the curvature allows
            w1 = wy - g / (scale * curve)
            w1 = np.sign(w1) * np.maximum(np.abs(w1) - l1 / (scale * curve), 0)
            b1 = by - gb / (scale * 0.25)
            z1, c1 = x.sums(w1) + b1, a.sums(w1) - b.sums(w1)
            d, db = w1 - wy, b1 - by
            if scale > 1e6 or loss(z1, c1) <= fy + g @ d + gb * db + scale / 2 * (curve @ (d * d) + 0.25 * db * db) + 1e-12:
                break
            scale *= 2
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((wy - w1) * curve) @ (w1 - w) + 0.25 * (by - b1) * (b1 - bias) > 0:
            t, t1 = 1.0, 1.0
        k = (t - 1) / t1
        wy, by, zy, cy = w1 + k * (w1 - w), b1 + k * (b1 - bias), z1 + k * (z1 - z), c1 + k * (c1 - change)
        w, bias, z, change, t = w1, b1, z1, c1, t1
    keep = np.flatnonzero(w)
    return ToxicityModel(used[keep], w[keep], bias)


def chosen(pairs: list[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    """At most so many of a text's pairs, those first by a hash of place and sentence, so from all over the text."""
    at = sorted(range(len(pairs)), key=lambda i: (zlib.crc32(f"{i} {pairs[i][0]}".encode("utf-8", "replace")), i))
    return [pairs[i] for i in sorted(at[:most])]


def _features(most: int):
    @F.pandas_udf("bins binary, pairs array<binary>, n long")
    def features(texts: pd.Series) -> pd.DataFrame:
        bins, pairs = [], []
        texts = [t if isinstance(t, str) else "" for t in texts]
        for lo, hi in slices(texts):
            bins += [b.astype(np.int32).tobytes() for b in bins_of(texts[lo:hi])]
            for t in texts[lo:hi]:
                both = bins_of([s for pair in chosen(swapped(t), most) for s in pair])
                pairs.append([b.astype(np.int32).tobytes() for b in both])
        return pd.DataFrame({"bins": bins, "pairs": pairs, "n": [(len(b) + sum(map(len, p))) // 4 for b, p in zip(bins, pairs)]})

    return features


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = FIT_PER_LABEL, lam: float = 5.0, pairs_per_text: int = PAIRS_PER_TEXT, fit_features: int = FIT_FEATURES) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1): whole texts of up to per_label rows of each
    label, the first by a hash of doc_id (of repeated ids the least text), as long as their features and those of their
    pairs are at most fit_features together; weighted so that the labels keep their shares. Up to pairs_per_text sentences
    a text that hold identity terms, by a hash over the whole text, give counterfactual pairs. Null labels, ids or texts
    are left out; a doc_id with several labels counts with each; empty texts are texts without features, repeated rows
    count once; other columns are not read. Without rows, or of one label alone, the model is a constant."""
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    share = {r.toxic: r.n for r in known.distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = first_by_hash(known, "toxic", per_label)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))
    rows = stored(texts.select("doc_id", "toxic", "order", _features(pairs_per_text)("text").alias("x")).select("doc_id", "toxic", "order", "x.*"))
    before = F.sum("n").over(Window.orderBy("order", "doc_id", "toxic"))  # of a bounded number of rows, without their features
    within = rows.select("doc_id", "toxic", before.alias("used"), "order", "n").where(F.col("used") <= fit_features).select("doc_id", "toxic")
    y, features, pairs = [], [], []
    for r in rows.join(F.broadcast(within), ["doc_id", "toxic"]).orderBy("order", "doc_id", "toxic").select("toxic", "bins", "pairs").collect():
        y.append(r.toxic)
        features.append(np.frombuffer(bytes(r.bins), np.int32))
        both = [np.frombuffer(bytes(p), np.int32) for p in r.pairs]
        pairs += zip(both[::2], both[1::2])
    n = np.bincount(y, minlength=2)
    return train(features, np.array(y, float), np.array([share[k] / n[k] for k in y], float), pairs, lam)


def score_toxicity(model: ToxicityModel, text: Column) -> Column:
    """The score (0 to 1) of each whole text, which depends on the text alone: equal texts tie. Null and empty texts get the
    bias alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = np.zeros(BINS)
        weight[model.features] = model.weights
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            z = np.full(len(texts), model.bias)
            for lo, hi in slices(texts):
                h, start = word_hashes(texts[lo:hi])
                b = (h % np.uint64(BINS)).astype(np.int64)
                hit = np.flatnonzero(weight[b])
                own = np.searchsorted(start, hit, "right") - 1
                pair = np.unique(own * BINS + b[hit])
                np.add.at(z, lo + pair // BINS, weight[pair % BINS])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(text)
