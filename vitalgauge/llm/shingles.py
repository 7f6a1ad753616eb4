"""Words, word shingles and MinHash signatures of many texts at once, with numpy.

Texts are UTF-8 bytes end to end.  A-Z count as a-z; words are runs of bytes other than
U+0020 and U+0009 to U+000D; a shingle is a 64-bit hash of some words in a row.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .encode import mix

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] = _LOW[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: For terms: everything ASCII that is no letter or digit divides; bytes from 128 on are letters.
_DIVIDES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Masks of the first 0 to 8 bytes of a little-endian word, and a longer run's limit.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of many runs of bytes: eight bytes at a time are mixed into what is
    known of the run so far, so no two of its parts can cancel.  Runs over ``LONG`` bytes have
    a BLAKE2 digest instead."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size + 1)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(todo):
        part = eight[start[todo] + at] & _HEAD[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words of each text."""
    full = ~blank[data]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    first = at[:-1][at[:-1] < at[1:]]
    last = at[1:][at[:-1] < at[1:]] - 1
    begin[first] = full[first]
    end[last] = full[last]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.diff(np.searchsorted(start, at))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in order, and the number of words of each text."""
    start, stop, n = word_spans(data, at)
    return run_hashes(_LOW[data], start, stop), n


def distinct_terms(data: np.ndarray, at: np.ndarray, bits: int, stem: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text, hashed to ``bits`` bits, end to end, and their number.

    Terms are the words and, of words longer than ``stem`` bytes, their first ``stem`` bytes.
    """
    start, stop, n = word_spans(data, at, _DIVIDES)
    values = _LOW[data]
    stop = np.stack([stop, np.minimum(stop, start + stem)], 1)
    h = run_hashes(values, np.repeat(start, 2), stop.ravel()).reshape(-1, 2)
    h[:, 1] = np.where(stop[:, 0] > stop[:, 1], mix(h[:, 1] + np.uint64(1)), h[:, 0])
    h = (h.ravel() >> np.uint64(64 - bits)).astype(np.int32)
    n = 2 * n
    cuts = np.concatenate([[0], np.cumsum(n)])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cuts[:-1][n > 0]] = True
    return h[new], _spread(new, cuts, n)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, end to end, and their number.

    A text of fewer words than ``width`` has its whole sequence as its one shingle; a text
    without words has none.
    """
    h, words = word_hashes(data, at)
    odd = [np.uint64(mix(np.array([k + 1]))[0] | np.uint64(1)) for k in range(width)]
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    begin = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = np.minimum(np.repeat(words, n), width)
    total = size.astype(np.uint64)
    for k in range(width):
        take = begin + k
        take[size <= k] = 0
        total += np.where(size > k, h.take(take, mode="clip") if len(h) else np.uint64(0), np.uint64(0)) * odd[k]
    total = mix(total)
    cuts = np.concatenate([[0], np.cumsum(n)])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        total[s:e].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[cuts[:-1][n > 0]] = True
    return total[new], np.add.reduceat(new, cuts[:-1][n > 0], dtype=np.int64) if (n > 0).all() and len(n) else _spread(new, cuts, n)


def _spread(new: np.ndarray, cuts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.int64)
    if len(new):
        out[n > 0] = np.add.reduceat(new, cuts[:-1][n > 0], dtype=np.int64)
    return out


def signatures(sets: np.ndarray, n: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` 32-bit minima for each text that has a shingle."""
    at = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(at), coordinates), np.uint32)
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    if len(at):
        for c in range(coordinates):
            x = (sets * (seeds[2 * c] | np.uint64(1)) + seeds[2 * c + 1]) >> np.uint64(32)
            out[:, c] = np.minimum.reduceat(x, at)
    return out


def set_digests(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone, for each text that has a shingle."""
    at = (np.cumsum(n) - n)[n > 0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.add.reduceat(mix(sets), at), np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
