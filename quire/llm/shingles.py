"""Word shingles of whole texts as 64-bit hashes, over many texts at a time.

Words are the runs of bytes other than space and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased; a text's set holds
the hashes of its distinct runs of WIDTH words, with fewer words the whole sequence as one, without words nothing.

A word's hash is the sum of a mixed number for each of its bytes at its place in the word, mixed again: nothing binds the
numbers of different bytes or places to each other, so words collide as random numbers do and not by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _random.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_SHORT = _random.integers(0, 1 << 63, WIDTH + 1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about BLOCK_BYTES; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the hashes of text k are hashes[bounds[k]:bounds[k + 1]], in order, repeats included."""
    n, docs = len(data), len(offsets) - 1
    none = np.zeros(docs + 1, dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=np.uint64), none
    gap = _SPACE[data]
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = np.empty(n, dtype=bool)
    start[0], start[1:] = True, gap[:-1]
    start |= first
    start &= ~gap
    last = np.empty(n, dtype=bool)
    last[-1], last[:-1] = True, gap[1:] | first[1:]
    last &= ~gap
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), none
    place = np.cumsum(start)  # number of the word that a byte is in, or stands after
    place = np.arange(n) - starts[np.maximum(place, 1) - 1]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(_BYTE[data] + place.astype(np.uint64) * _STEP), out=total[1:])
    words = mix(total[ends] - total[starts])
    at = np.searchsorted(starts, offsets)  # first word of each text
    count = np.diff(at)
    full = np.maximum(count - WIDTH + 1, 0)
    out = np.where(count > 0, np.maximum(full, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(out)])
    hashes = np.empty(bounds[-1], dtype=np.uint64)
    total_words = len(words)
    if total_words >= WIDTH:
        runs = sum((words[k : total_words - WIDTH + 1 + k] * _PLACE[k] for k in range(1, WIDTH)), words[: total_words - WIDTH + 1] * _PLACE[0])
        of = np.repeat(np.arange(docs), full)
        within = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(full)[:-1]]), full)
        hashes[bounds[of] + within] = runs[at[of] + within]
    for k in np.flatnonzero((count > 0) & (count < WIDTH)):
        w = words[at[k] : at[k + 1]]
        hashes[bounds[k]] = np.append(w * _PLACE[: len(w)], _SHORT[len(w)]).sum(dtype=np.uint64)
    return mix(hashes), bounds


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, offsets, data in blocks(texts):
        hashes, bounds = shingles(offsets, data)
        for k in range(len(bounds) - 1):
            yield np.unique(hashes[bounds[k] : bounds[k + 1]])
