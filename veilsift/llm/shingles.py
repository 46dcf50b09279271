"""Word shingles and fast similarity sketches of many texts at once, in numpy.

Words are runs of bytes other than TAB..CR and space, with A-Z lowered. A word's hash takes eight of
its bytes a step and mixes after each, so no words are known to collide (a polynomial modulo 2**64
would: long words of two letters in the order of Thue and Morse, whatever its base). Words of over
LONG_WORD bytes are hashed by xxh3.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n of eight little-endian bytes.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 1024
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 5
_SEGMENT = 1 << 20

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, _SEGMENT + 1)
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = pow(_BASE, -1, 2**64)
        _inverse = np.multiply.accumulate(step)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def loads(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and length."""
    eights, out = loads(data), lengths.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    rest = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(rest):
        chunk = eights[starts[rest] + at] & LOW[np.minimum(lengths[rest] - at, 8)]
        mixed = (out[rest] ^ chunk) * U(0xD6E8FEB86659FD93)
        out[rest] = mixed ^ (mixed >> U(32))
        at += 8
        rest = rest[lengths[rest] > at]
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].data)
    return out


def runs(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class (0: skipped): hash, text number, byte place, length, class.

    ``classes`` gives a class to each byte and 0 to white space. Works through segments of bounded size.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    while at < len(data):
        to = min(len(data), at + _SEGMENT)
        while to < len(data) and classes[data[to - 1]]:  # a segment ends with white space
            more = np.flatnonzero(classes[data[to : to + _SEGMENT]] == 0)
            to = to + int(more[0]) + 1 if len(more) else min(len(data), to + _SEGMENT)
        part = data[at:to]
        kind = np.concatenate([[0], classes[part], [0]]).astype(np.uint8)
        turns = np.flatnonzero(kind[1:] != kind[:-1])
        inner = kind[turns[:-1] + 1] != 0
        first, last = turns[:-1][inner], turns[1:][inner]
        for x, y in zip(found, (word_hashes(_LOWER[part], first, last - first), first + at, last - first, kind[first + 1]), strict=True):
            x.append(y)
        at = to
    h, place, length, kinds = (np.concatenate(x) for x in found)
    return mix(h), np.searchsorted(ends, place, side="right"), place, length, kinds


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    return runs(texts, _WORD.astype(np.uint8))[:2]


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; a shorter text is one shingle, an empty one none."""
    h, own = words(texts)
    counts = np.bincount(own, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = len(h) - size + 1
    if n > 0:
        g = np.full(n, size, np.uint64)
        for j in range(size):
            g = mix(g * U(_BASE) + h[j : j + n])
    out = []
    for i, m in enumerate(counts.tolist()):
        a = int(starts[i])
        if m >= size:
            out.append(np.unique(g[a : a + m - size + 1]))
        elif m:
            one = np.full(1, m, np.uint64)
            for j in range(m):
                one = mix(one * U(_BASE) + h[a + j : a + j + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def blocks(texts: list[bytes], most: int = 1 << 20):
    """Runs of texts of about ``most`` bytes (one longer text at least)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


_EMPTY = U(2**64 - 1)
_VALUE = U(2**40 - 1)


def sketches(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches of t coordinates, one row a set.

    In each of the first t rounds every element falls into one hashed bin with a hashed value; in
    round t + j every element falls into bin j, so after 2t rounds each bin is full. A bin keeps the
    smallest value of the earliest round that reached it (the round is in the value's high bits), and
    a set leaves as soon as all its bins are full. The rows of empty sets stay at the largest value.
    """
    out = np.full((len(sets), t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return out
    items = np.concatenate([sets[i] for i in live])
    own = np.repeat(live, [len(sets[i]) for i in live])
    for k in range(2 * t):
        x = mix(items + mix(np.full(1, seed * 100_003 + k, np.uint64)))
        value = (x & _VALUE) | U(k << 40)
        spot = own * t + (((x >> U(40)) * U(t)) >> U(24)).astype(np.int64) if k < t else own * t + (k - t)
        np.minimum.at(flat, spot, value)
        full = (out[live] != _EMPTY).all(axis=1)
        if full.any():
            if full.all():
                break
            done = np.zeros(len(sets), bool)
            done[live[full]] = True
            keep = ~done[own]
            items, own, live = items[keep], own[keep], live[~full]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, t = sketch.shape
    bands = t // rows
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * U(_BASE) + sketch[:, j : bands * rows : rows])
    return key


def set_digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that identify a set."""
    a = np.array([mix(s ^ U(0xA5A5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    b = np.array([mix(s * U(3) + U(0x5A5A)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    spot = np.searchsorted(b, a)
    spot[spot == len(b)] = len(b) - 1
    return int((b[spot] == a).sum())
