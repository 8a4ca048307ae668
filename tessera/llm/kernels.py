"""Vectorised byte kernels shared by the operators.

Texts reach Python as Arrow binary columns. A batch is cut into slices of a few hundred kilobytes so that the
temporaries of a numpy pass stay small whatever the batch size; only a single text larger than a slice makes a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Null ids sort behind every id; results show them as null again.
NO_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, derived from the seed."""
    return mix(np.arange(1, 257, dtype=np.uint64) * MULT + np.uint64(seed))


#: \x20 and \x09-\x0D separate words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANK
#: 0-9, a-z and every byte of a non-ASCII character, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to limit bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length()) if n else 1 << 12
    if size not in _powers:
        base = np.uint64(0xD1342543DE82EF95)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        tables = []
        for b in (base, inverse):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = tuple(tables)
    return _powers[size]


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, text number) of the words of the texts data[off[i]:off[i + 1]].

    A word is a maximal run of bytes for which is_word holds; it never crosses texts. The hash is a polynomial over
    random byte values: a difference of prefix sums, brought to the power 0.
    """
    lo, hi = int(off[0]), int(off[-1])
    own = data[lo:hi]
    if not len(own):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    inside = is_word[own]
    first = np.empty(len(own), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    starts_at = off[:-1] - lo
    starts_at = starts_at[starts_at < len(own)]
    first[starts_at] = True
    first &= inside
    starts = np.flatnonzero(first)
    last = np.empty(len(own), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[starts_at[starts_at > 0] - 1] = True
    last &= inside
    ends = np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(own) + 1)
    sums = np.empty(len(own) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte_table(seed)[own] * power[: len(own)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts + lo, ends + lo, hashes, np.searchsorted(off, starts + lo, "right") - 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for t in range(k):
        out *= MULT
        out += hashes[t : t + n]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w consecutive entries, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal neighbours."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate((at[1:] - 1, [len(s) - 1]))]
