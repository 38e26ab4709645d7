"""Words, word hashes and shingles of a batch of texts in NumPy.

A batch is one byte buffer with offsets, as Arrow holds it. The hash of a word is a
difference of a running polynomial over its bytes, so no Python loop runs over words.
Hashes have 64 bits and are mixed, so equal hashes stand for equal words or shingles.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _PRIME)

#: Bytes that part words: the six of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII characters but letters and digits part words.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


#: Bytes whose running polynomial is formed at once, whatever a text's length.
_STEP = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse for the places of a step."""
    up, down = np.full(_STEP, _PRIME), np.full(_STEP + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each span of ``values`` (spans in any order, overlaps allowed): the sum of value * prime ** place in the span.

    Values are taken by steps of fixed size, so the running sums stay small; a span over
    several steps is the sum of its parts, each moved to its place.
    """
    up, down = _powers()
    out = np.zeros(len(start), _U)
    by_start = np.argsort(start, kind="stable") if len(start) and (start[1:] < start[:-1]).any() else np.arange(len(start))
    first_of = start[by_start]
    waiting = np.zeros(0, np.int64)  # spans that began in a step before and have not ended
    for at in range(0, len(values), _STEP):
        part = values[at : at + _STEP]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        new = by_start[np.searchsorted(first_of, at) : np.searchsorted(first_of, at + len(part))]
        own = np.concatenate([waiting, new])
        x, y = np.maximum(start[own] - at, 0), np.minimum(end[own] - at, len(part))
        h = (total[y] - total[x]) * down[x]
        if len(waiting):
            h[: len(waiting)] *= np.array([pow(int(_PRIME), int(n), 1 << 64) for n in at - start[waiting]], _U)
        out[own] += h
        waiting = own[end[own] > at + len(part)]
    return out


class _Values:
    """The values of bytes, made for the slice that is asked for."""

    def __init__(self, data: np.ndarray, fold: np.ndarray):
        self.data, self.of = data, _BYTE[fold]

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.of[self.data[part]]


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # where texts begin, and the end
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    word_at: np.ndarray  # first word of each text, and the end
    hash: np.ndarray
    fold: np.ndarray  # the byte that each byte counts as


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, beginning at 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, between: np.ndarray = SPACE, fold: np.ndarray = SAME) -> Words:
    data, at = buffer(texts)
    n = len(data)
    inside = np.zeros(n + 2, bool)  # a byte that parts words before the first and after the last
    inside[1:-1] = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # a text's border parts words as white space does
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    h = mix(spans_hash(_Values(data, fold), start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    return Words(data, at, start, end, np.searchsorted(start, at), h, fold)


def prefixes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n bytes of the words that are longer, and the numbers of these words."""
    long = np.flatnonzero(w.end - w.start > n)
    raw = np.zeros(len(long), _U)
    for i in range(n):
        raw += _BYTE[w.fold[w.data[w.start[long] + i]]] * _U(pow(int(_PRIME), i, 1 << 64))
    return mix(raw + _U(n * 0xA0761D6478BD642F % (1 << 64))), long


class Points:
    """Code points before a byte, from the places of the bytes that continue one: few in most texts."""

    def __init__(self, data: np.ndarray):
        self.continued = np.flatnonzero((data & 0xC0) == 0x80)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at - np.searchsorted(self.continued, at)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, whatever text they are in."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, _U)
    for i in range(n):
        total = total * _PRIME + hashes[i : i + count]
    return mix(total + _U(n))


def inner_windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words that lie in one text, and their first words."""
    count = max(0, len(w.hash) - n + 1)
    text = text_of_words(w)
    first = np.flatnonzero(text[:count] == text[n - 1 : n - 1 + count])
    return windows(w.hash, n)[first], first


def text_of_words(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.word_at) - 1), np.diff(w.word_at))


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text, A-Z lower-cased.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    w = words(texts, SPACE, LOWER)
    h = windows(w.hash, n)
    out = []
    for a, b in zip(w.word_at[:-1].tolist(), w.word_at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(h[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(windows(w.hash[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte or word) over each text."""
    out = np.zeros(len(at) - 1, np.int64)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some], dtype=np.int64)
    return out
