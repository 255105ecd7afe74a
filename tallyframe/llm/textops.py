"""Vectorised helpers for tasks: hashes of words, word shingles and character q-grams of a batch of texts.

A word is a longest run of ASCII letters, digits and non-ASCII characters, in lower case. Hashes are 64 bits wide,
depend on the word alone, and are the same on every machine.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at once; a longer text is cut between words.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 under which near values become unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, CHUNK + 1), base)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _hash_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _WORD[buf]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first, mix((total[last] - total[first]) * down[first])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words start (one more entry than texts)."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    start = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=start[1:])
    buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    at, found, lo = [], [], 0
    while lo < len(buf):
        hi = min(lo + CHUNK, len(buf))
        while hi < len(buf) and _WORD[buf[hi - 1]]:
            more = np.flatnonzero(~_WORD[buf[hi : hi + CHUNK]])
            hi = hi + int(more[0]) + 1 if len(more) else min(hi + CHUNK, len(buf))
        first, h = _hash_runs(buf[lo:hi])
        at.append(first + lo)
        found.append(h)
        lo = hi
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    found = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return found, np.searchsorted(at, start)


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text's index, hash, times it occurs), sorted by index and hash.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    words, start = word_hashes(texts)
    count = np.diff(start)
    own = np.repeat(np.arange(len(texts)), count)
    most = max(0, len(words) - width + 1)
    sh = np.zeros(most, np.uint64)
    for j in range(width):
        sh = sh * _BASE + words[j : j + most]
    full = np.flatnonzero(np.arange(most) + width <= start[own[:most] + 1])
    few = np.flatnonzero((count > 0) & (count < width))
    short = np.zeros(len(few), np.uint64)
    for j in range(width - 1):
        more = np.flatnonzero(count[few] > j)
        short[more] = short[more] * _BASE + words[start[few[more]] + j]
    sh, own = mix(np.concatenate([sh[full], short])), np.concatenate([own[full], few])
    order = np.lexsort((sh, own))
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], sh[at], np.diff(np.append(at, len(sh)))


def slices(texts: list[str | None], most: int = CHUNK):
    """Ranges (from, to) of texts holding about `most` characters each; a longer text comes alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
