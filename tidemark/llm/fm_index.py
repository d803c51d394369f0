"""A compressed FM-index over sequences of numbers, with backward search over a wavelet matrix.

The text's rotations are sorted to a fixed depth (ties by place), which is enough for searches of at most that
depth. The last column is held as a wavelet matrix: one bit vector per bit of a symbol, with counts of ones
per 64 bits; runs of rows that agree in all but the last number are bits too, and places take 32 bits. All
operations work on many searches at once.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values among their distinct values."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.empty(len(values), dtype=np.int64)
    fresh[:1] = 0
    np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
    out = np.empty(len(values), dtype=np.int64)
    out[order] = fresh
    return out


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], 0 beyond the end."""
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def _ranked(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits in words of 64, and the ones before each word."""
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), dtype=_U)
    return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers from 0 to size - 1."""

    def __init__(self, sequence: np.ndarray, size: int):
        n = len(sequence)
        self.levels = max(1, (size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            words, counts = _ranked(bit)
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.base = self.down(np.zeros(size, dtype=np.int64), np.arange(size))

    def down(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the symbols before each place end up in the sequence's last order."""
        for i in range(self.levels):
            word = place >> 6
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((_U(1) << (place & 63).astype(_U)) - _U(1)))
            bit = (symbol >> (self.levels - 1 - i)) & 1
            place = np.where(bit == 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        return self.down(place, symbol) - self.base[symbol]


class FmIndex:
    """Search in a text of numbers for sequences of at most depth numbers.

    order lists the text's places in the order of the depth numbers that start there, equal ones by place.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        self.alphabet = np.unique(text)
        symbol = np.searchsorted(self.alphabet, text)
        ranks, have = {1: symbol}, 1
        while 2 * have <= depth:
            r = ranks[have]
            ranks[2 * have] = _dense(r * (n + 1) + _ahead(r + 1, have))
            have *= 2
        full, done = ranks[have], have
        for step in sorted(ranks, reverse=True):  # the rest of the depth by its binary digits
            if done + step <= depth:
                full = _dense(full * (n + 1) + _ahead(ranks[step] + 1, done))
                done += step
        order = np.argsort(full, kind="stable")
        self.order = order.astype(np.int32) if n < 1 << 31 else order
        self.symbols = len(self.alphabet)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=self.symbols))))
        self.last = WaveletMatrix(symbol[self.order - 1], self.symbols)
        # rows that agree in depth - 1 numbers are neighbours: a bit where a run of them starts
        same = np.ones(n, dtype=bool)
        done = 0
        for step in sorted(ranks, reverse=True):
            while done + step <= depth - 1:
                r = _ahead(ranks[step] + 1, done)[self.order]
                same[1:] &= r[1:] == r[:-1]
                done += step
        same[:1] = False
        self.run_words, self.run_counts = _ranked(~same)
        self.run_starts = np.append(np.flatnonzero(~same), n).astype(self.order.dtype)

    def shortened(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the rows that agree with each row in depth - 1 numbers."""
        word = row >> 6
        run = self.run_counts[word] + np.bitwise_count(self.run_words[word] & ((_U(2) << (row & 63).astype(_U)) - _U(1))) - 1
        return self.run_starts[run].astype(np.int64), self.run_starts[run + 1].astype(np.int64)

    def encode(self, numbers: np.ndarray) -> np.ndarray:
        """Symbols of numbers, -1 for those that the text does not have."""
        at = np.minimum(np.searchsorted(self.alphabet, numbers), self.symbols - 1)
        return np.where(self.alphabet[at] == numbers, at, -1)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of symbol followed by the sequences whose rows these were."""
        n = len(low)
        rank = self.last.rank(np.concatenate((low, high)), np.concatenate((symbol, symbol)))
        start = self.first[symbol]
        return start + rank[:n], start + rank[n:]

    def matching(self, queries: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the queries: the rows [low, high) of the depth numbers that start there; low = high where
        the text has no such sequence or the query ends before.

        queries holds the queries one after another, ends where each ends. All are streamed at once from their
        right ends: a match of full depth loses its last number (rows that agree in depth - 1 numbers) and is
        extended by the next number on the left; one that failed starts again from the right.
        """
        begins = np.concatenate(([0], ends[:-1]))
        symbol = self.encode(queries)
        low_out, high_out = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        at = ends - self.depth  # the start that is searched next
        lane = np.flatnonzero(at >= begins)
        held = np.zeros(len(ends), dtype=bool)
        low, high = np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
        while len(lane):
            fast, slow = lane[held[lane]], lane[~held[lane]]
            if len(fast):
                row = low[fast]
                sym = symbol[at[fast]]
                a, b = self.shortened(row)
                known = sym >= 0
                lo, hi = np.zeros(len(fast), dtype=np.int64), np.zeros(len(fast), dtype=np.int64)
                lo[known], hi[known] = self.extend(a[known], b[known], sym[known])
                low[fast], high[fast] = lo, hi
            if len(slow):
                lo, hi = np.zeros(len(slow), dtype=np.int64), np.full(len(slow), len(self.order), dtype=np.int64)
                live = np.arange(len(slow))
                for back in range(self.depth - 1, -1, -1):
                    sym = symbol[at[slow[live]] + back]
                    none = sym < 0
                    hi[live[none]] = lo[live[none]]
                    live, sym = live[~none], sym[~none]
                    lo[live], hi[live] = self.extend(lo[live], hi[live], sym)
                    live = live[lo[live] < hi[live]]
                    if not len(live):
                        break
                low[slow], high[slow] = lo, hi
            held[lane] = low[lane] < high[lane]
            got = lane[held[lane]]
            low_out[at[got]], high_out[at[got]] = low[got], high[got]
            at[lane] -= 1
            lane = lane[at[lane] >= begins[lane]]
        return low_out, high_out
