"""Whole Arrow batches of text as flat numpy arrays: words, word hashes and hashes of word windows.

A word is a run of bytes other than space and 0x09-0x0D, so words can be found on the UTF-8 bytes. All texts of a
slice lie in one byte array; nothing is done row by row. Texts are whole: a slice ends between two texts, and a text
longer than ``SLICE_BYTES`` is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Breaks for tokens that are runs of letters and digits: white space and ASCII punctuation.
PLAIN_BREAKS = _SPACE.copy()
PLAIN_BREAKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64); a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U) * _ODD[0] + _U(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {(seed, lower): _byte_values(seed, lower) for seed in (0, 1) for lower in (False, True)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = int(_ODD[which])
        size = max(n, SLICE_BYTES + 1024)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of some texts. ``first[i]:first[i + 1]`` are the words of text i; starts and ends are bytes of ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word; ``lower``: as if A-Z were lower-cased."""
        return span_hashes(self.data, self.starts, self.ends, lower, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False,
                seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans by one running sum of value times power."""
    up, down = powers(len(data), seed)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[seed, lower][data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]) if len(starts) else np.zeros(0, _U)


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; a word never crosses two texts."""
    solid = ~breaks[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = solid[edges]
    ends[edges[1:] - 1] = solid[edges[1:] - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values of h (also across texts; the caller masks those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = powers(len(h), seed)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def window_inside(words: Words, width: int) -> np.ndarray:
    """Whether the window of ``width`` words that starts at each word lies in one text."""
    last = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(len(words.starts)) + width <= last


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset:]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0]:], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all the ranges starts[i] .. starts[i] + lengths[i], one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
