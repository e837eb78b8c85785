"""Vectorised text primitives over Arrow string buffers, shared by the operators.

A block is a run of whole rows of about ``BLOCK_BYTES`` of UTF-8; a longer row is a block of its own
and goes through every primitive in steps of ``STEP``, so that what grows with the row is its
results (a number for each word or line), never figures for each byte.
White space is the six ASCII characters ``[\\x20\\x09-\\x0D]``; they and A-Z never occur inside a
multi-byte UTF-8 character, so splitting and lower-casing on bytes is exact.

A span's hash sums, over its 8-byte pieces, a mix of the piece and its place, and mixes the sum with
the length. It is no polynomial in the bytes, so no family of texts collides by structure (a
polynomial modulo 2^64 takes Thue-Morse strings for each other, whatever its base). Where equal
hashes mean that texts are taken for equal, a second sum makes them 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Bytes, words or pieces that a primitive looks at in one step.
STEP = 1 << 20

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = (np.arange(256) & 0xC0) == 0x80
_PLACE, _LENGTH, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Rows ``lo:hi`` of a batch: ``data`` (uint8) and ``bounds`` (row r is ``data[bounds[r]:bounds[r+1]]``)."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds
        self.rows = hi - lo

    def mapped(self, table: np.ndarray) -> Block:
        """The block with each byte replaced by ``table[byte]``."""
        return Block(self.lo, self.hi, table[self.data], self.bounds)

    def lowered(self) -> Block:
        return self.mapped(_LOWER)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """Row of each byte position."""
        if self.rows == 1:
            return np.zeros(len(at), np.int32)
        return np.searchsorted(self.bounds, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every maximal run without white space, within rows."""
        n = len(self.data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self.rows == 1 and n > STEP:
            return self._words_of_one_row()
        solid = ~_WS[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = self.bounds[:-1][self.bounds[:-1] < n]
        first[heads] = solid[heads]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = self.bounds[1:] - 1
        tails = tails[(tails >= 0) & (self.bounds[1:] > self.bounds[:-1])]
        last[tails] = solid[tails]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _words_of_one_row(self) -> tuple[np.ndarray, np.ndarray]:
        n, starts, ends, before = len(self.data), [], [], False
        for lo in range(0, n, STEP):
            solid = ~_WS[self.data[lo : lo + STEP]]
            change = np.flatnonzero(np.diff(solid, prepend=before)).astype(np.int32) + np.int32(lo)
            opens = np.arange(len(change)) % 2 == int(before)
            starts.append(change[opens])
            ends.append(change[~opens])
            before = bool(solid[-1])
        if before:
            ends.append(np.array([n], np.int32))
        return np.concatenate(starts), np.concatenate(ends)

    def span_counts(self, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many bytes of each span ``table`` (256 truths) marks."""
        at = [np.flatnonzero(table[self.data[lo : lo + STEP]]).astype(np.int32) + np.int32(lo) for lo in range(0, len(self.data), STEP)]
        at = np.concatenate(at) if at else np.empty(0, np.int32)
        return np.searchsorted(at, ends) - np.searchsorted(at, starts) if len(at) else np.zeros(len(starts), np.int64)

    def span_points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points in each span (spans begin and end between characters)."""
        return (ends - starts).astype(np.int64) - self.span_counts(_INNER, starts, ends)

    def per_row(self, table: np.ndarray) -> np.ndarray:
        """How many of each row's bytes ``table`` (256 truths) marks."""
        out = np.zeros(self.rows, np.int64)
        for lo in range(0, len(self.data), STEP):
            at = np.flatnonzero(table[self.data[lo : lo + STEP]]) + lo
            out += np.bincount(self.row_of(at), minlength=self.rows)
        return out

    def _pieces(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes from ``at`` up to ``ends``, eight at most, as integers."""
        n = len(self.data)
        data = self.data if n >= 8 and self.data.flags.c_contiguous else np.concatenate([self.data, np.zeros(8, np.uint8)])
        n = len(data) - 8
        view = np.ndarray((n + 1,), "<u8", data, 0, (1,))
        value = view[np.minimum(at, n)]
        late = np.flatnonzero(at > n)
        value[late] >>= ((at[late] - n) * 8).astype(np.uint64)
        return value & _MASKS[np.minimum(ends - at, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, wide: bool = False):
        """64-bit hash of the bytes of each span; with ``wide`` a second, independent one too."""
        size = (ends - starts).astype(np.int64)
        one, two = np.zeros(len(size), np.uint64), np.zeros(len(size) if wide else 0, np.uint64)

        def add(own, at, place):
            piece = mix(self._pieces(at, ends[own]) + place.astype(np.uint64) * _PLACE)
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            one[own[cut]] += np.add.reduceat(piece, cut)
            if wide:
                two[own[cut]] += np.add.reduceat(mix(piece ^ _SECOND), cut)

        some = np.flatnonzero(size > 0)
        for lo in range(0, len(some), STEP):
            own = some[lo : lo + STEP]
            add(own, starts[own], np.zeros(len(own), np.int64))
        long = np.flatnonzero(size > 8)
        bounds = np.r_[0, np.cumsum((size[long] - 1) >> 3)]  # pieces after the first
        for lo in range(0, int(bounds[-1]), STEP):
            hi = min(lo + STEP, int(bounds[-1]))
            a, b = np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi)
            own = np.repeat(np.arange(a, b), np.minimum(bounds[a + 1 : b + 1], hi) - np.maximum(bounds[a:b], lo))
            place = np.arange(lo, hi) - bounds[own] + 1
            add(long[own], starts[long[own]] + 8 * place, place)
        length = size.astype(np.uint64) * _LENGTH
        one = mix(one + length)
        return (one, mix(two ^ length)) if wide else one

    def row_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hash of each row, as two arrays."""
        return self.hashes(self.bounds[:-1], self.bounds[1:], wide=True)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every line; an empty row has one empty line."""
        n = len(self.data)
        breaks = [np.flatnonzero(self.data[lo : lo + STEP] == 10) + lo for lo in range(0, n, STEP)]
        breaks = np.concatenate(breaks) if breaks else np.empty(0, np.int64)
        if self.rows == 1:
            return np.r_[0, breaks + 1], np.r_[breaks, n], np.zeros(len(breaks) + 1, np.int64)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        kind = np.concatenate([np.arange(self.rows), self.row_of(breaks) if len(breaks) else breaks])
        order = np.lexsort((starts, kind))
        starts, rows = starts[order], kind[order]
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        if len(ends):
            ends[-1] = n
        final = np.ones(len(starts), bool)
        final[:-1] = rows[1:] != rows[:-1]
        ends[final] = self.bounds[rows[final] + 1]
        return starts, ends, rows


def blocks(texts: pa.Array) -> Iterator[Block]:
    """Blocks of whole rows of a string array; null counts as empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words of a row; a row with 1 to size-1 words gives one of all its words."""
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    count = np.bincount(row, minlength=rows)
    parts, owners = [], []
    for lo in range(0, max(0, len(words) - size + 1), STEP):
        m = min(STEP, len(words) - size + 1 - lo)
        total = np.zeros(m, np.uint64)
        for k in range(size):
            total += words[lo + k : lo + k + m] * weights[k]
        own = row[lo : lo + m]
        whole = own == row[lo + size - 1 : lo + size - 1 + m]
        parts.append(mix(total[whole]))
        owners.append(own[whole])
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = first[short]
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            total[has] += words[at[has] + k] * weights[k]
        parts.append(mix(total + count[short].astype(np.uint64)))
        owners.append(short.astype(row.dtype))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def row_sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row, then value."""
    if len(rows) and rows[0] == rows[-1] and rows.min() == rows.max():  # one row: no order of rows to keep beside
        values = np.unique(values)
        return values, np.full(len(values), rows[0], rows.dtype)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]
