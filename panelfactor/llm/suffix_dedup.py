"""Suffix-array dedup: remove every byte that a LENGTH-byte string of an earlier document covers.

1. Blocks. Texts are packed as bytes, once, into a table bucketed by block; later steps that need the texts meet
   them by bucket, so that texts are never shuffled.
2. Passages. The smallest hash of the 19-byte pieces of a string is the same wherever the string is. Consecutive
   strings with one smallest hash make a passage, about one for each 16 bytes. Only hashes (the passages' keys) are
   shuffled, a block's key once; those that two different texts hold go back to the blocks as one bit each.
3. Contexts. The bytes of passages with such keys are sent to the shard of their key, equal ones of a block once: equal strings
   have equal keys and so meet in one shard.
4. Suffix arrays. Each shard sorts the suffixes of its contexts by Larsson-Sadakane refinement; Kasai common prefixes
   of LENGTH or more bind equal strings, whose smallest document is the first to hold them.
   A key whose contexts may exceed a shard is cut into several: each lists its strings in the order of its suffix array, the
   lists of all shards of the key are merged by binary search, part by part, and what another shard holds in an earlier document
   goes back before the shard decides.
5. Strings held by an earlier document return to the blocks as intervals of contexts, and the blocks, which find their
   contexts again, remove them. A whole text that an earlier document repeats is one interval (found by 128 bits of hash).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .skew import split_join
from .suffix_arrays import common_prefixes, suffix_array
from .textkernel import Block, blocks, mix

LENGTH, PIECE = 50, 19
#: Bytes of texts in one block, of texts in one bucket, and of contexts in one shard; a key with passages of over HEAVY bytes has shards of its own.
BLOCK, BUCKET, SHARD, HEAVY = 8 << 20, 64 << 20, 4 << 20, 1 << 20
#: Keys of one range; bytes that are hashed at once; Spark's bound on buckets; about what a context takes.
RANGE, STEP, MAX_BUCKETS, CONTEXT = 1_000_000, 1 << 18, 100_000, 70

_BLOCKS = "block long, ids array<long>, bounds binary, one binary, two binary, data binary"
_KEYS = "part long, of long, n long, keys binary, codes binary, texts binary, counts binary"
_BITS = "of long, part long, n long, shared long, bits binary, heavy binary"
_PACKS = "block long, shard long, slice long, slices long, numbers binary, sizes binary, lows binary, highs binary, contexts binary"
_STRINGS = "key long, part long, slice long, strings binary, lows binary"
_BETTER = "key long, slice long, strings binary, lows binary"
_RETURNED = "of long, kind int, part long, slice long, n long, one binary, two binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: What goes back to the blocks: the keys' bits, intervals of contexts, whole rows.
KEY_BITS, CUTS, WHOLE = 0, 1, 2

_HEAVY = np.dtype([("key", "<u8"), ("slices", "<i8")])
_CUT = np.dtype([("number", "<i4"), ("from", "<i8"), ("to", "<i8"), ("low", "<i8")])
_SPAN = np.dtype([("row", "<i4"), ("from", "<i8"), ("to", "<i8")])


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``data`` cut at ``cuts`` (in elements), as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, plane by plane: planes of zeros compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def _unplanes(raw: pa.BinaryScalar, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _packed(batches):
    """Texts in, blocks of about BLOCK bytes out; a longer text is a block of its own. Blocks have the task's number and their own."""
    held, size, number = [], 0, 0

    def block():
        ids = pa.chunked_array([x for x, _ in held]).combine_chunks()
        ends = np.cumsum(np.concatenate([np.diff(b.bounds) for _, b in held]))
        one, two = (np.concatenate(x) for x in zip(*(b.row_hashes() for _, b in held), strict=True))
        data = np.concatenate([b.data for _, b in held])
        name = (TaskContext.get().partitionId() << 32) + number
        columns = [[name], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()]) for x in (np.r_[0, ends].astype(np.int64), one, two)), _slices(data, np.array([0, len(data)]))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_fields(_BLOCKS))

    for batch in batches:
        for b in blocks(batch.column("text")):
            if held and size + len(b.data) > BLOCK:
                yield block()
                held, size, number = [], 0, number + 1
            held.append((batch.column("doc_id").slice(b.lo, b.rows), b))
            size += len(b.data)
    if held:
        yield block()


class Texts:
    """One block: ``ids`` (0 where there is none), ``known`` (whether there is one), ``data``, ``bounds``, and each text's hash."""

    def __init__(self, table: pa.Table):
        ids = table["ids"].combine_chunks().flatten()
        self.block = table["block"][0].as_py()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.bounds = np.frombuffer(table["bounds"][0].as_buffer(), np.int64)
        self.one = np.frombuffer(table["one"][0].as_buffer(), np.uint64)
        self.data = np.frombuffer(table["data"][0].as_buffer(), np.uint8)


def passages(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(key, row, first, end) of each passage: its strings begin at ``first`` up to ``end``, in one row."""
    window, found = length - piece + 1, []
    rows = bounds[:-1]
    for lo in range(0, len(data) - length + 1, STEP):
        part = data[lo : lo + STEP + length - 1]
        raw = np.concatenate([part, np.zeros(8, np.uint8)])
        words = np.ndarray((len(part) + 1,), "<u8", raw, 0, (1,))
        n = len(part) - piece + 1
        least = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, piece - 7, 8):
            least ^= least >> np.uint64(29)
            least += words[k : k + n]
            least *= np.uint64(0xBF58476D1CE4E5B9)
        least ^= least >> np.uint64(32)
        least += words[piece - 8 : piece - 8 + n]
        least *= np.uint64(0x94D049BB133111EB)
        least ^= least >> np.uint64(31)
        width = 1
        while width < window:  # the smallest of ever more neighbours
            by = min(width, window - width)
            least = np.minimum(least[:-by], least[by:])
            width += by
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[rows[np.searchsorted(rows, lo) : np.searchsorted(rows, lo + len(least))] - lo] = True
        first = np.flatnonzero(change)
        found.append((mix(least[first]), first + lo, np.r_[first[1:], len(least)] + lo))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    key, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(bounds, first, side="right") - 1
    end = np.minimum(end, bounds[row + 1] - length + 1)
    whole = end > first
    return key[whole], row[whole], first[whole], end[whole]


def _of_documents(texts: Texts, length: int) -> tuple[np.ndarray, ...]:
    """Passages of the rows that have an id."""
    key, row, first, end = passages(texts.data, texts.bounds, length)
    known = texts.known[row]
    return key[known], row[known], first[known], end[known]


def _keys(length: int, parts: int):
    """The distinct keys of a block by range, each with the number of its text; the last number stands for several texts."""

    def run(table: pa.Table) -> pa.Table:
        texts = Texts(table)
        key, row, _, _ = _of_documents(texts, length)
        distinct, code = np.unique(texts.one, return_inverse=True)
        order = np.argsort(key)
        key, code = key[order], code[row[order]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.r_[first, len(key)]).astype(np.uint32)
        if len(first):
            low, high = np.minimum.reduceat(code, first), np.maximum.reduceat(code, first)
            key, code = key[first], np.where(low == high, low, len(distinct))
        part = ((key >> np.uint64(33)).astype(np.int64) * parts) >> 31
        used = np.unique(part)
        out = []
        for p, a, b in zip(used, np.searchsorted(part, used), np.searchsorted(part, used, side="right"), strict=True):
            own, short = np.unique(code[a:b], return_inverse=True)
            several = len(own) > 0 and own[-1] == len(distinct)
            names = distinct[own[: len(own) - several]]
            short = short.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
            deltas = np.diff(key[a:b], prepend=np.uint64(0))
            out.append([int(p), texts.block, int(b - a), _planes(deltas), short.tobytes(), names.tobytes(), _planes(counts[a:b])])
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64()] * 3 + [pa.binary()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_fields(_KEYS))

    return run


def _shared(table: pa.Table) -> pa.Table:
    """All blocks' keys of one range in; for each block one bit for each of its keys out, whether two texts hold it, and the
    shared keys whose passages may exceed a shard, with the number of shards for them.
    """
    sizes = table["n"].to_numpy()
    ends = np.cumsum(sizes)
    keys, names, counts, several = (np.zeros(ends[-1], t) for t in (np.uint64, np.uint64, np.uint32, bool))
    for k, (n, end) in enumerate(zip(sizes, ends, strict=True)):
        at = slice(end - n, end)
        keys[at] = np.cumsum(_unplanes(table["keys"][k], np.uint64), dtype=np.uint64)
        counts[at] = _unplanes(table["counts"][k], np.uint32)
        codes = table["codes"][k].as_buffer()
        codes = np.frombuffer(codes, np.uint16 if codes.size == 2 * n else np.uint32)
        texts = np.frombuffer(table["texts"][k].as_buffer(), np.uint64)
        several[at] = codes == len(texts)
        names[at] = np.r_[texts, np.uint64(0)][codes]
    order = np.argsort(keys)
    keys, names, counts, several = keys[order], names[order], counts[order], several[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    both = (np.minimum.reduceat(names, first) != np.maximum.reduceat(names, first)) | np.logical_or.reduceat(several, first)
    volume = np.add.reduceat(counts, first, dtype=np.int64) * CONTEXT
    slices = np.where(both & (volume > HEAVY), -(-volume // SHARD), 0)
    runs = np.diff(np.r_[first, len(keys)])
    flags, cut = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    flags[order], cut[order] = np.repeat(both, runs), np.repeat(slices, runs)
    back = np.empty(len(keys), np.uint64)
    back[order] = keys
    bits, shared, heavy = [], [], []
    for n, end in zip(sizes, ends, strict=True):
        own, many = flags[end - n : end], cut[end - n : end]
        some = np.flatnonzero(many)
        told = np.empty(len(some), _HEAVY)
        told["key"], told["slices"] = back[end - n : end][some], many[some]
        bits.append(np.packbits(own).tobytes())
        shared.append(int(own.sum()))
        heavy.append(told.tobytes())
    return pa.table([table["of"], table["part"], table["n"], pa.array(shared, pa.int64()), pa.array(bits, pa.binary()), pa.array(heavy, pa.binary())], names=_fields(_BITS))


class Contexts:
    """The passages of a block whose keys two texts hold, sorted so that equal contexts follow each other.

    ``first``, ``end``, ``row`` of each; ``begin``: where each distinct context begins among them; ``shard``, ``slice``,
    ``slices`` of each distinct context (slice -1: the shard is not cut). The same for the same block and bits.
    """

    def __init__(self, texts: Texts, bits: list[tuple[int, bytes, bytes]], shards: int, length: int):
        """bits: number of keys, bits and heavy keys of each range, in order."""
        key, row, first, end = _of_documents(texts, length)
        flags = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b, _ in bits)])
        heavy = np.concatenate([np.empty(0, _HEAVY), *(np.frombuffer(h, _HEAVY) for _, _, h in bits)])
        some = flags[np.searchsorted(np.unique(key), key)] if len(key) else np.zeros(0, bool)
        key, row, first, end = key[some], row[some], first[some], end[some]
        one, two = Block(0, 1, texts.data, np.array([0, len(texts.data)])).hashes(first, end + length - 1, wide=True)
        order = np.lexsort((first, two, one, key))
        key, one, two = key[order], one[order], two[order]
        self.row, self.first, self.end = row[order], first[order], end[order]
        self.begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(key) else np.empty(0, np.int64)
        key, one = key[self.begin], one[self.begin]
        self.shard, self.slice, self.slices = (key % np.uint64(shards)).astype(np.int64), np.full(len(key), -1), np.zeros(len(key), np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy["key"], key), len(heavy) - 1)
            own = heavy["key"][at] == key
            self.slices[own] = heavy["slices"][at[own]]
            self.shard[own] = key[own].view(np.int64)
            self.slice[own] = (one[own] % self.slices[own].astype(np.uint64)).astype(np.int64)

    def groups(self) -> list[np.ndarray]:
        """The numbers of the contexts of each shard and slice."""
        order = np.lexsort((self.slice, self.shard))
        a, b = self.shard[order], self.slice[order]
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        return np.split(order, cuts) if len(order) else []


def _packs(length: int, shards: int):
    """A block and its keys' bits in; its distinct contexts for each shard out, with the smallest and largest document of each."""
    kinds = [pa.int64()] * 4 + [pa.binary()] * 5
    schema = pa.schema(list(zip(_fields(_PACKS), kinds, strict=True)))

    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows or not bits.num_rows:
            return schema.empty_table()
        texts = Texts(table)
        found = Contexts(texts, list(zip(*(bits.sort_by("part")[c].to_pylist() for c in ("n", "bits", "heavy")), strict=True)), shards, length)
        out = []
        if len(found.begin):
            ids = texts.ids[found.row]
            low, high = np.minimum.reduceat(ids, found.begin), np.maximum.reduceat(ids, found.begin)
        for own in found.groups():
            at = found.begin[own]
            sizes = found.end[at] + length - 1 - found.first[at]
            ends = np.cumsum(sizes)
            raw = texts.data[np.repeat(found.first[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
            blobs = [own.astype(np.int32).tobytes(), _planes(sizes.astype(np.int32)), _planes(low[own]), _planes(high[own]), pa.compress(raw.tobytes(), "zstd", asbytes=True)]
            out.append([texts.block, int(found.shard[own[0]]), int(found.slice[own[0]]), int(found.slices[own[0]]), *blobs])
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    return run


class Shard:
    """The suffix array of a shard's contexts: its suffixes of ``length`` bytes or more in order, and the runs of equal strings.

    ``of``: the distinct context of each that came, ``lows`` the smallest document of each run.
    """

    def __init__(self, table: pa.Table, length: int):
        sizes = [_unplanes(x, np.int32).astype(np.int64) for x in table["sizes"]]
        raw = np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), int(n.sum()), "zstd"), np.uint8) for x, n in zip(table["contexts"], sizes, strict=True)])
        sizes = np.concatenate(sizes)
        bounds = np.r_[0, np.cumsum(sizes)]
        low = np.concatenate([_unplanes(x, np.int64) for x in table["lows"]])
        one, two = Block(0, len(sizes), raw, bounds).row_hashes()
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        begin = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        self.of = np.empty(len(sizes), np.int64)
        self.of[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        own = order[begin]  # one that came for each distinct context
        sizes = sizes[own]
        self.bounds = np.r_[0, np.cumsum(sizes)]
        self.data = raw[np.repeat(bounds[own] - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])]
        self.length, low = length, np.minimum.reduceat(low[order], begin)
        places, near = suffix_array(self.data, self.bounds, length)
        prefix = common_prefixes(self.data, self.bounds, places, near, length)
        self.context = np.repeat(np.arange(len(sizes)), sizes)
        long = self.bounds[1:][self.context[places]] - places >= length
        # a suffix that is too short shares less than length with both neighbours, so no run is lost with it
        self.order = places[long]
        self.first = np.flatnonzero(prefix[long] < length)
        if len(self.order):
            self.lows = np.minimum.reduceat(low[self.context[self.order]], self.first)

    def strings(self) -> np.ndarray:
        """The distinct strings in order, as rows of bytes."""
        return self.data[self.order[self.first][:, None] + np.arange(self.length)] if len(self.order) else np.empty((0, self.length), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of string starts with one smallest document (``_CUT``), sorted by distinct context, and where each context's begin."""
        at = self.order
        low = np.repeat(self.lows, np.diff(np.r_[self.first, len(at)]))
        by = np.argsort(at)
        at, low = at[by], low[by]
        own = self.context[at]
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (low[1:] != low[:-1])])
        out = np.empty(len(new), _CUT)
        out["from"], out["low"], out["number"] = at[new] - self.bounds[own[new]], low[new], own[new]
        out["to"] = at[np.r_[new[1:], len(at)] - 1] + 1 - self.bounds[own[new]]
        return out, np.searchsorted(out["number"], np.arange(len(self.bounds)))


def _find(strings: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of ``strings`` lies among the sorted ``among`` by binary search: the first that is not smaller."""
    # numpy searches words, not bytes: one step of the search for each word, within the range of equal earlier words
    words = lambda x: np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(">u8").astype(np.uint64)
    mine, theirs = words(strings), words(among)
    low, high = np.zeros(len(strings), np.int64), np.full(len(strings), len(among))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        a, b = theirs[middle], mine[open_]
        differ = a != b
        place = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        smaller = differ[rows, place] & (a[rows, place] < b[rows, place])
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]


def _slice_strings(length: int):
    """A shard of a cut key in; its strings in order and the smallest document of each out, by part of strings."""

    def run(table: pa.Table) -> pa.Table:
        shard, key, number, parts = Shard(table, length), table["shard"][0].as_py(), table["slice"][0].as_py(), table["slices"][0].as_py()
        strings = shard.strings()
        flat = Block(0, 1, strings.ravel(), np.array([0, strings.size]))
        starts = np.arange(len(strings)) * length
        part = (flat.hashes(starts, starts + length) % np.uint64(parts)).astype(np.int64)
        used = np.unique(part)
        rows = [(key, int(p), number, strings[part == p].tobytes(), shard.lows[part == p].tobytes()) for p in used]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], names=_fields(_STRINGS))

    return run


def _merge(length: int):
    """The sorted lists of a key's shards in; for each shard the strings that another has in an earlier document out."""

    def run(table: pa.Table) -> pa.Table:
        lists = [(np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, length), np.frombuffer(v.as_buffer(), np.int64)) for s, v in zip(table["strings"], table["lows"], strict=True)]
        merged, lows = lists[0]
        for strings, own in lists[1:]:
            at = _find(strings, merged)
            there = at < len(merged)
            there[there] = (merged[at[there]] == strings[there]).all(axis=1)
            lows = lows.copy()
            lows[at[there]] = np.minimum(lows[at[there]], own[there])
            merged, lows = np.insert(merged, at[~there], strings[~there], axis=0), np.insert(lows, at[~there], own[~there])
        out = []
        for number, (strings, own) in zip(table["slice"].to_pylist(), lists, strict=True):
            best = lows[_find(strings, merged)]
            better = best < own
            if better.any():
                out.append((table["key"][0].as_py(), number, strings[better].tobytes(), best[better].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 2, strict=True)], names=_fields(_BETTER))

    return run


def _returned(rows: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_fields(_RETURNED))


def _decide(length: int):
    """A shard's contexts, and what its key's other shards hold in earlier documents; what the blocks' contexts may lose out."""

    def run(table: pa.Table, better: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _returned([])
        shard = Shard(table, length)
        if better.num_rows:
            mine = shard.strings()
            for strings, lows in zip(better["strings"], better["lows"], strict=True):
                at = _find(np.frombuffer(strings.as_buffer(), np.uint8).reshape(-1, length), mine)
                shard.lows[at] = np.minimum(shard.lows[at], np.frombuffer(lows.as_buffer(), np.int64))
        runs, first = shard.runs()
        out, came = [], 0
        for block, numbers, highs, number, part in zip(*(table[c] for c in ("block", "numbers", "highs", "shard", "slice")), strict=True):
            numbers, high = np.frombuffer(numbers.as_buffer(), np.int32), _unplanes(highs, np.int64)
            of = shard.of[came : came + len(numbers)]
            came += len(numbers)
            sizes = first[of + 1] - first[of]
            at = np.repeat(first[of] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            cuts = runs[at]
            cuts["number"] = np.repeat(numbers, sizes)
            cuts = cuts[cuts["low"] < np.repeat(high, sizes)]  # some document of the block is later
            if len(cuts):
                out.append([block.as_py(), CUTS, number.as_py(), part.as_py(), len(cuts), cuts.tobytes(), b""])
        return _returned(out)

    return run


def _rows(length: int):
    """Block, row, id and hash of each row with an id and ``length`` bytes or more."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids").slice(k, 1).flatten()
                bounds = np.frombuffer(batch.column("bounds")[k].as_buffer(), np.int64)
                at = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bounds) >= length))
                one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64)[at] for c in ("one", "two"))
                columns = [np.full(len(at), batch.column("block")[k].as_py()), at.astype(np.int32), ids.take(pa.array(at)), np.diff(bounds)[at], one, two]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "row", "doc_id", "n", "one", "two"])

    return run


def _whole(batches):
    """Rows that an earlier document repeats, packed for their block."""
    for batch in batches:
        block, row = batch.column("block").to_numpy(), batch.column("row").to_numpy()
        by = np.argsort(block, kind="stable")
        used, first = np.unique(block[by], return_index=True)
        rows = [[int(of), WHOLE, 0, 0, len(own), own.tobytes(), b""] for of, own in zip(used, np.split(row[by].astype(np.int32), first[1:]), strict=True)]
        yield from _returned(rows).to_batches()


def _spans(texts: Texts, back: pa.Table, shards: int, length: int) -> np.ndarray:
    """What each row of a block loses (``_SPAN``), from all that came back to it."""
    rows = back.select(_fields(_RETURNED)).to_pylist()
    bits = sorted((r["part"], r["n"], r["one"], r["two"]) for r in rows if r["kind"] == KEY_BITS)
    cuts = np.concatenate([np.empty(0, _CUT), *(np.frombuffer(r["one"], _CUT) for r in rows if r["kind"] == CUTS)])
    whole = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r["one"], np.int32) for r in rows if r["kind"] == WHOLE)])
    spans = np.empty(len(whole), _SPAN)
    spans["row"], spans["from"], spans["to"] = whole, 0, np.diff(texts.bounds)[whole]
    if not len(cuts):
        return spans
    found = Contexts(texts, [x[1:] for x in bits], shards, length)
    ends = np.r_[found.begin[1:], len(found.first)]
    sizes = ends[cuts["number"]] - found.begin[cuts["number"]]
    # each interval of a context, at each of the context's places
    place = np.repeat(found.begin[cuts["number"]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    cut = np.repeat(np.arange(len(cuts)), sizes)
    row = found.row[place]
    lost = cuts["low"][cut] < texts.ids[row]
    place, cut, row = place[lost], cut[lost], row[lost]
    more = np.empty(len(place), _SPAN)
    start = found.first[place] - texts.bounds[row]
    more["row"], more["from"], more["to"] = row, start + cuts["from"][cut], start + cuts["to"][cut] + length - 1
    return np.concatenate([spans, more])


def _removed(length: int, shards: int):
    """A block and what came back to it in; a row for each of its rows out."""
    names = _fields(_RESULT)
    kinds = [pa.int64()] * 4 + [pa.string()]

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        texts = Texts(table)
        n = np.diff(texts.bounds)
        lost = _spans(texts, back, shards, length)
        begin, end = texts.bounds[lost["row"]] + lost["from"], texts.bounds[lost["row"]] + lost["to"]
        by = np.argsort(begin)
        begin, end, row = begin[by], np.maximum.accumulate(end[by]) if len(by) else end, lost["row"][by]
        # spans of one row that touch are one; rows are never joined
        new = np.flatnonzero(np.r_[True, (begin[1:] > end[:-1]) | (row[1:] != row[:-1])]) if len(by) else np.empty(0, np.int64)
        begin, row = begin[new], row[new]
        end = end[np.r_[new[1:], len(by)] - 1] if len(new) else end
        removed = np.bincount(row, weights=end - begin, minlength=len(n)).astype(np.int64)
        count = np.bincount(row, minlength=len(n))
        data, digests = memoryview(texts.data), []
        at = np.searchsorted(row, np.arange(len(n) + 1))
        for k in range(len(n)):
            state, here = hashlib.sha256(), texts.bounds[k]
            for s in range(at[k], at[k + 1]):
                state.update(data[here : begin[s]])
                here = end[s]
            state.update(data[here : texts.bounds[k + 1]])
            digests.append(state.hexdigest())
        ids = table["ids"].combine_chunks().flatten()
        return pa.table([pa.array(c) if not isinstance(c, pa.Array) else c for c in (ids, n, removed, count, digests)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    Texts count as UTF-8 bytes (null: none). A row loses each byte that lies in a string of ``length`` bytes (``PIECE`` + 7 at
    least) that also begins in a row with a smaller doc_id; strings are judged on the whole input. Rows with one id, repeated or not, take
    nothing from each other; a null id is neither smaller nor larger than another, so its row loses nothing and takes nothing.
    Texts may have any length below 2 GB. Extra columns are ignored; an empty table gives no rows.
    """
    if length < PIECE + 7:
        raise ValueError(f"length must be {PIECE + 7} or more")
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(total / BUCKET)))
    texts = store.bucketed(slim.mapInArrow(_packed, _BLOCKS), "dedup-blocks", "block", n)
    parts = max(1, math.ceil(total / (length - PIECE) * 2 / RANGE))
    keys = texts.groupBy("block").applyInArrow(_keys(length, parts), _KEYS)
    bits = store.written(keys.groupBy("part").applyInArrow(_shared, _BITS), "dedup-bits")
    shards = max(1, math.ceil((bits.agg(F.sum("shared")).first()[0] or 0) * CONTEXT / SHARD))
    packs = store.written(texts.groupBy("block").cogroup(store.again(bits).groupBy("of")).applyInArrow(_packs(length, shards), _PACKS), "dedup-packs")
    strings = packs.where("slices > 1").groupBy("shard", "slice").applyInArrow(_slice_strings(length), _STRINGS)
    better = strings.groupBy("key", "part").applyInArrow(_merge(length), _BETTER)
    cuts = store.again(packs).groupBy("shard", "slice").cogroup(better.groupBy("key", "slice")).applyInArrow(_decide(length), _RETURNED)

    rows = store.written(texts.select("block", "ids", "bounds", "one", "two").mapInArrow(_rows(length), "block long, row int, doc_id long, n long, one long, two long"), "dedup-rows")
    copied = rows.groupBy(F.col("one").alias("_one"), F.col("two").alias("_two")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    whole = split_join(store.again(rows), copied, {"one": "_one", "two": "_two"}, "copies", rows.count()).where("doc_id > first").select("block", "row", "n").mapInArrow(_whole, _RETURNED)
    zero = F.lit(0).cast("long")
    known = store.again(bits).select("of", F.lit(KEY_BITS).alias("kind"), "part", zero.alias("slice"), "n", F.col("bits").alias("one"), F.col("heavy").alias("two"))
    back = cuts.unionByName(whole).unionByName(known)
    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_removed(length, shards), _RESULT)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: repeats removed from every text of the whole ``documents`` table."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, p, substr(x, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS p FROM t)),
f AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s HAVING count(*) > 1),
h AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM s JOIN f USING (s) WHERE low < doc_id),
i AS (SELECT r, p, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM h),
c AS (SELECT r, k, min(p) AS a, max(p) + {LENGTH} AS b FROM i GROUP BY r, k),
g AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM c),
k AS (SELECT r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM g JOIN t USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
