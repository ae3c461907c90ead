"""Hashes of words and of k-word shingles, vectorised over the bytes of Arrow strings.

Words are the runs between [\\x20\\x09-\\x0D]; A-Z count as a-z. A word's hash is a sum of per-byte random numbers times
powers of an odd number modulo 2^64, mixed afterwards; a shingle's hash mixes its words' hashes. A text with fewer words
than k has its whole sequence as its one shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_random = lambda n: _rng.integers(0, 2**64, n, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = _random(256)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _random(64) | np.uint64(1)
#: Texts are hashed about this many bytes at a time, so temporary arrays stay small and in cache.
STEP = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def _words(data: np.ndarray, begins: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie one after the other in data, and each word's first byte."""
    gap = space[data]
    first = ~gap
    first[1:] &= gap[:-1]
    inner = begins[(begins > 0) & (begins < len(data))]
    first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.arange(starts[0], len(data), dtype=np.int64)
    at -= np.repeat(starts, np.diff(starts, append=len(data)))
    body, gap = data[starts[0] :], gap[starts[0] :]
    at[gap] = 0
    values = BYTE[body] * powers(int(at.max()) + 1)[at]
    values[gap] = 0
    sums = np.add.reduceat(values, starts - starts[0])
    return mixed(sums + np.uint64(1)), starts


def _cut(data: np.ndarray, at: int, end: int, space: np.ndarray) -> int:
    """A place after `at`, near at + STEP, where no word is cut."""
    to = at + STEP
    while to < end:
        near = np.flatnonzero(space[data[to : to + 4096]])
        if len(near):
            return to + int(near[0])
        to += 4096
    return end


def word_hashes(column: pa.Array, space: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """The word hashes of each text of a string column without nulls, in order. space: the bytes between words."""
    if not len(column):
        return
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        if bounds[i + 1] - bounds[i] > 2 * STEP:  # a very long text, in steps of its own
            parts, at = [], int(bounds[i])
            while at < bounds[i + 1]:
                to = _cut(data, at, int(bounds[i + 1]), space)
                parts.append(_words(data[at:to], np.zeros(1, np.int64), space)[0])
                at = to
            yield np.concatenate(parts)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 2 * STEP, side="right")) - 1)
        begins = bounds[i : j + 1] - bounds[i]
        hashes, starts = _words(data[bounds[i] : bounds[j]], begins[:-1], space)
        cuts = np.searchsorted(starts, begins)
        for k in range(j - i):
            yield hashes[cuts[k] : cuts[k + 1]]
        i = j


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, ascending."""
    if not len(words):
        return words
    n = min(k, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total += words[i : i + count] * PLACE[i]
    total = mixed(total)
    total.sort()
    if count > 1:
        total = total[np.concatenate(([True], total[1:] != total[:-1]))]
    return total


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    return (shingle_set(words, k) for words in word_hashes(column))
