"""Hashes of the words of many texts at once, on the bytes of an Arrow string column.

A word is a run of bytes other than space and U+0009 to U+000D, which in UTF-8 is the same as a run of such
characters. Its hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose words are hashed at once.
_SPAN = 1 << 20
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept in this process for the longest use so far."""
    if len(_tables.get("up", ())) < n:
        n = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(n, base, dtype=_U)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of each word in the texts data[offsets[i]:offsets[i + 1]], in their order."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, bounds = data[low:high], offsets - low
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(_U), none, none, none
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]  # a word ends where its text does
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = np.empty(len(start), dtype=_U)
    at = 0
    while at < len(start):  # some words at a time, so that long texts need no long tables
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SPAN, side="right")))
        low_, high_ = int(start[at]), int(end[to - 1])
        up, down = _powers(high_ - low_ + 1)
        total = np.zeros(high_ - low_ + 1, dtype=_U)
        np.cumsum((data[low_:high_].astype(_U) + _U(1)) * up[: high_ - low_], out=total[1:])
        value[at:to] = (total[end[at:to] - low_] - total[start[at:to] - low_]) * down[start[at:to] - low_]
        at = to
    text = np.searchsorted(bounds, start, side="right") - 1
    return mix(value + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)), text, start + low, end + low


def pieces(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, data, offsets) for runs of rows of a string column, of about most_bytes or one text each."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, place, body = column.buffers()
    offsets = np.frombuffer(place, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, data, offsets[at : to + 1]
        at = to


def shingles(word: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k words within one text."""
    if len(word) < k:
        return word[:0], text[:0]
    n = len(word) - k + 1
    value = np.zeros(n, dtype=_U)
    for i in range(k):
        value = value * _U(0xD1342543DE82EF95) + word[i : i + n]
    whole = text[:n] == text[k - 1 :]
    return mix(value[whole]), text[:n][whole]
