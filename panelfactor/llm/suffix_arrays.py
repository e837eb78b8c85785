"""Suffix arrays of short-lived shards, in numpy: Larsson-Sadakane refinement and Kasai common prefixes.

A shard is a run of pieces laid end to end; no suffix goes beyond its piece, and one that ends sorts
before one that goes on.
"""

from __future__ import annotations

import numpy as np

#: Bytes in a first key; its last byte says how many there are.
FIRST = 7
#: Common prefixes are followed so far at a time.
REACH = 4_096


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as little-endian integers; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _remaining(bounds: np.ndarray) -> np.ndarray:
    """Bytes from each position to its piece's end."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def suffix_array(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the first ``depth`` bytes (at least) of their suffixes, and which of them
    begin as the one before does (for FIRST bytes).

    ``bounds``: where the pieces of ``data`` begin, and its end. Groups of equal prefixes are refined by the group of
    the suffix that begins where the prefix ends, which doubles its length; single suffixes are left alone.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    remaining = _remaining(bounds)
    key = _words(data)[:n].byteswap()
    key >>= np.uint64(8)
    short = np.flatnonzero(remaining < FIRST)
    gone = (8 * (FIRST - remaining[short])).astype(np.uint64)
    key[short] = (key[short] >> gone) << gone
    key = (key << np.uint64(8)) | np.minimum(remaining, FIRST).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del key
    near = ~new
    # a group's number is its first place, plus one; zero stands for the end of a piece
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    h = FIRST
    while h < depth:
        single = new & np.r_[new[1:], True]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        who = order[at]
        group = rank[who]
        after = np.where(remaining[who] > h, rank[np.minimum(who + h, n - 1)], 0)
        by = np.argsort(group.astype(np.int64) << 32 | after) if n < 1 << 31 else np.lexsort((after, group))
        who, group, after = who[by], group[by], after[by]
        order[at] = who
        new[at] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[who] = np.maximum.accumulate(np.where(new[at], at, 0)) + 1
        h *= 2
    return order, near


def _extended(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes agree from ``a`` and from ``b`` on, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        so_far = out[left]
        differ = words[a[left] + so_far] ^ words[b[left] + so_far]
        same = np.full(len(left), 8)
        some = np.flatnonzero(differ)
        low = differ[some] & (~differ[some] + np.uint64(1))  # the lowest bit that differs
        same[some] = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        out[left] = np.minimum(so_far + same, most[left])
        left = left[(same == 8) & (out[left] < most[left])]
    return out


def common_prefixes(data: np.ndarray, bounds: np.ndarray, order: np.ndarray, near: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of each suffix of ``order`` and the one before it (0 at first): exact from FIRST to ``length``,
    less than FIRST or ``length`` at least elsewhere, as it is there. ``near``: as :func:`suffix_array` tells.

    As Kasai's algorithm goes through the text: where the suffix one further on meets the neighbour one further on, the
    common prefix is one less and nothing is compared. Only where that ends are bytes looked at.
    """
    n = len(order)
    if not n:
        return np.empty(0, np.int64)
    words, remaining = _words(data), _remaining(bounds)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    begin = np.zeros(n, bool)
    begin[bounds[:-1][np.diff(bounds) > 0]] = True
    follows = ~begin
    follows[1:] &= before[1:] == before[:-1] + 1
    follows &= before >= 0
    # the neighbour may begin a piece, which its predecessor has no part in
    follows[follows] &= ~begin[before[follows]]
    head = ~follows
    prefix = np.zeros(n, np.int64)
    alike = np.zeros(n, bool)
    alike[order] = near
    fresh = np.flatnonzero(head)
    reach = max(REACH, 2 * length)
    while len(fresh):
        real = fresh[(before[fresh] >= 0) & alike[fresh]]
        prefix[real] = _extended(words, real, before[real], np.minimum(np.minimum(remaining[real], remaining[before[real]]), reach))
        at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        value = prefix[at] - (np.arange(n) - at)
        # beyond a mismatch, and where a head was followed no further, the comparison begins again
        cut = (prefix[at] == reach) & (value < length)
        lost = ~head & ((value < 0) | cut)
        lost[1:] &= ~lost[:-1] | head[:-1]
        fresh = np.flatnonzero(lost)
        head[fresh] = True
        if not len(fresh):
            prefix = np.where(head, prefix, np.maximum(value, 0))
    return prefix[order]
