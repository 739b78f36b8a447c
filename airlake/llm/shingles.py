"""Numpy helpers that run inside Spark tasks: word shingles of many texts at once and their sketches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0x5BF03635F0935AD1)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word in lower case, computed at first sight; emptied before it outgrows a task."""

    limit = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.lower())
        return value


def shingle_sets(texts: list[str], cache: WordHashes, width: int = 5):
    """(owner, shingle, count) of all texts: the multiset of lower-cased word runs of ``width``.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    Rows are ordered by owner, then shingle.
    """
    get, parts, sizes = cache.__getitem__, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        n = len(words)
        row = np.fromiter(map(get, words), np.uint64, n)
        if 0 < n < width:
            row = np.concatenate([row, np.full(width - n, _PAD, np.uint64)])
        sizes[i] = len(row)
        parts.append(row)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(sizes - width + 1, 0) * (sizes > 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(owner):
        return owner, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.repeat(starts[:-1], counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    value = np.zeros(len(owner), np.uint64)
    for k in range(width):
        value = mix(value * _GOLD + flat[first + k])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def fixed_cells(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    n, width = rows.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def content_keys(owner, value, count, n: int) -> list[bytes]:
    """A 128-bit key of each text's shingle multiset."""
    at = np.searchsorted(owner, np.arange(n + 1))
    packed = np.stack([value, count.astype(np.uint64)], 1) if len(value) else np.zeros((0, 2), np.uint64)
    return [hashlib.md5(packed[at[i] : at[i + 1]].tobytes()).digest() for i in range(n)]


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_minhash(owner, value, count, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (Ertl, 2018) of ``n`` weighted sets, an (n, m) array of 64-bit values.

    The weight axis is cut into the dyadic intervals (0,1], (1,2], (2,4], ... Every element owns one
    Poisson process for each interval below its weight, with rate m times the interval's width; a point
    carries a time, a register and a weight. Points above the element's weight are thinned out, and a
    register keeps its earliest point. Two sets agree in a register with the probability of their
    weighted Jaccard similarity. Processes run only to a time by which all registers are likely filled;
    sets with an empty register are run again to a later one, so every register is exact.
    """
    out = np.zeros((n, m), np.uint64)
    todo, reach = np.unique(owner), 8.0
    total = np.zeros(n)
    np.add.at(total, owner, count)
    while len(todo):
        part = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
        o, v, w = owner[part], value[part], count[part].astype(np.float64)
        end = reach / total
        slots, times, marks = [], [], []
        low = 0.0
        while len(o):
            width = max(low, 1.0)
            state = mix(v ^ np.uint64(int(low) * 0x9E37 + 0x1234567))
            t, po, pw = np.zeros(len(o)), o, w
            while len(po):
                state = state + _GOLD
                draw = mix(state)
                t = t - np.log(_unit(draw)) / (m * width)
                live = t <= end[po]
                if not live.all():
                    t, po, pw, state, draw = t[live], po[live], pw[live], state[live], draw[live]
                more = mix(draw ^ _GOLD)
                inside = low + _unit(mix(more)) * width <= pw if low else slice(None)
                slots.append((po * m + (more % np.uint64(m)).astype(np.int64))[inside])
                times.append(t[inside])
                marks.append(more[inside])
            low += width
            up = w > low
            o, v, w = o[up], v[up], w[up]
        slot, time, mark = (np.concatenate(x) for x in (slots, times, marks))
        order = np.argsort(-time, kind="stable")
        filled = np.zeros(n * m, bool)
        flat = out.reshape(-1)
        flat[slot[order]] = mark[order]
        filled[slot] = True
        todo = todo[~filled.reshape(n, m)[todo].all(1)]
        reach *= 3
    return out


def min_hash(owner, value, n: int, m: int) -> np.ndarray:
    """Plain MinHash signatures of ``n`` sets, an (n, m) array of 32-bit values; 0 for an empty set."""
    out = np.zeros((n, m), np.uint32)
    if not len(owner):
        return out
    rows = np.unique(owner)
    at = np.searchsorted(owner, rows)
    odd = mix(np.arange(1, m + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    for j in range(m):
        out[rows, j] = np.minimum.reduceat(((value * odd[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) signed 64-bit bucket ids; the band's number is part of the id."""
    h = np.zeros((len(signature), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    cube = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        h = mix(h * _GOLD + cube[:, :, r])
    return h.view(np.int64)


def pack(owner, value, count, n: int) -> list[bytes]:
    """The multisets as bytes: sorted 64-bit shingles, then their counts."""
    at = np.searchsorted(owner, np.arange(n + 1))
    small = count.astype(np.uint32)
    return [value[at[i] : at[i + 1]].tobytes() + small[at[i] : at[i + 1]].tobytes() for i in range(n)]


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def similarity(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard similarity of two packed multisets; 1 where both are empty."""
    (x, nx), (y, ny) = unpack(a), unpack(b)
    if not len(x) and not len(y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.where(y[at] == x, np.minimum(nx, ny[at]), 0).sum(dtype=np.int64)
    return float(both / (nx.sum(dtype=np.int64) + ny.sum(dtype=np.int64) - both))
