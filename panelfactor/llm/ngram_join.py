"""N-gram Jaccard join: exact near-duplicate classes of documents by signature trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets link when
100 * |intersection| >= 75 * |union|. Every link is found; the steps:

1. Sets. Equal sets are one set from here on (copies link trivially). A set's id is the first half of a
   128-bit hash of its tokens; ids under which the second halves differ are told apart by it.
2. Screen. Three eighths of the token values, cut to a few bits, are sent by range with their row in
   the flush. A set of which more of these values are met once than a link allows (over a quarter of all
   its tokens) has no link. The others stand in a Bloom filter: what it or a cut lets pass too costs
   time and changes no result.
3. Token counts. The (token, set) postings of sets that passed are partitioned by range of token; a
   token of one set only can't be shared. A set with more such tokens than a link allows is done; for
   the others the shared tokens return, with their counts. A task sends a set once, however many copies
   it meets, and tokens that a sample shows to be very frequent go past the grouping as shared and most
   frequent: which tokens those are changes no result, since prefixes only need one order of tokens for
   all sets.
4. Prefixes. With tokens ordered from rare to frequent, two linked sets share one of the first
   n - ceil(3n/4) + 1 tokens of each; these make the trees' buckets.
5. Stars. A bucket's hub is the member with the fewest tokens of its own, which edited copies of one
   text have in common; each set is held against the hub that it shares most buckets with. True
   links merge the large groups of near copies without their pairs.
6. Signature trees. In each bucket that still holds several classes the members, sorted by size, are
   leaves of a tree whose nodes hold OR-combined token bitmaps and size ranges; a dual traversal
   from the root drops pairs of nodes whose sizes can't match, that lie in one class, or whose
   largest possible overlap is too small. Buckets with many members are cut into a grid of cells.
   Pairs of leaves that remain are counted exactly.
7. Classes are connected components of all links.

Postings travel as packed byte planes of many tokens. The screen's name no set but the row in a flush,
so that they take about four bytes each however many ranges there are.
Ranges of tokens hold about GROUP_TOKENS each, however many there are. Joins whose key many rows may
share (a set with many copies, a class, a token, a hub) send hot keys to the rows (:mod:`skew`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .skew import split_join
from .textkernel import blocks, mix, row_sets, shingles

SIZE, PERCENT = 5, 75
#: Tokens that a task packs at once; tokens of one range; members of one tree before it is cut; bits of a bitmap; children of a node.
PACK, GROUP_TOKENS, BUCKET, BITS, FAN = 1_000_000, 1_000_000, 4_096, 1_024, 8
#: Bytes of tokens in one bucket of sets at most, and Spark's bound on buckets.
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 100_000
#: Rows of postings in one group of trees, and pairs of nodes looked at at once.
GROUP_POSTINGS, PAIRS = 60_000, 50_000
#: A token in MIN_HOT sets or more is sent past the grouping, at any size of corpus, so a group holds at most about MIN_HOT postings of
#: one token; such tokens are found in a sample that meets about SEEN of their sets. HOT_TOKENS bounds what is broadcast (8 bytes each).
MIN_HOT, SEEN, HOT_TOKENS = 50_000, 64, 1_000_000
#: The screen's share of token values, in what a link allows a set to hold alone; bits of a value beyond those that number all tokens.
SCREEN, SPARE_BITS = 1.5, 7
#: Bits of a slot of the filter of sets, bits for each set, and slots at most (128 MB); under FEW bits for each set everything passes instead.
SLOT_BITS, SET_BITS, MAX_SLOTS, FEW = 1 << 19, 16, 2_048, 4

_SETS = "doc_id long, text_key long, set_id long, twin long, n_shingles long"
_SCREENED = "part long, block long, tokens binary, owners binary"
_SCREEN_COUNTS = "block long, listed boolean, owners binary, counts binary"
_PACKED = "part long, tokens binary, owners binary, sets binary, sizes binary"
_SHARED = "part long, tokens binary, counts binary, sets binary, sizes binary, lengths binary"
_SURVIVORS = "set_id long, n long, tokens binary, prefix array<long>, bits binary"


def shingle_sets(b, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's rows, with their rows."""
    low = b.lowered()
    starts, ends = low.words()
    return row_sets(*shingles(low.hashes(starts, ends), low.row_of(starts), low.rows, size))


def _fingerprints(tokens: np.ndarray) -> np.ndarray:
    """What a token adds to the first half of its set's hash."""
    return mix(tokens + np.uint64(0x5851F42D4C957F2D))


def _set_ids(tokens: np.ndarray, rows: np.ndarray, n: int, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id of each row's set, the second half of its hash, and its size; ids in ``split`` become ids of both halves."""
    cuts = np.searchsorted(rows, np.arange(n + 1))
    counts = np.diff(cuts)
    some = counts > 0
    halves = []
    for values in (_fingerprints(tokens), mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F))):
        sums = np.zeros(n, np.uint64)
        if some.any():
            sums[some] = np.add.reduceat(values, cuts[:-1][some])
        halves.append(mix(sums ^ mix(counts.astype(np.uint64))))
    ids, twins = halves
    both = np.isin(ids.view(np.int64), split)
    ids[both] = mix(ids[both] + mix(twins[both]))
    return ids.view(np.int64), twins.view(np.int64), counts


def _sets(size: int, split: np.ndarray):
    def run(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                ids, twins, counts = _set_ids(*shingle_sets(b, size), b.rows, split)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(b.lo, b.rows) for c in ("doc_id", "text_key")), *map(pa.array, (ids, twins, counts))], names=["doc_id", "text_key", "set_id", "twin", "n_shingles"])

    return run


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, plane by plane: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(raw) else np.empty(0, dtype)


def _pack_tokens(ordered: np.ndarray) -> bytes:
    return _planes(np.diff(ordered, prepend=np.uint64(0)))


def _unpack_tokens(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _part(value: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 0 .. 2^64 a value lies in."""
    return ((value >> np.uint64(33)).astype(np.int64) * parts) >> 31


def _hot_tokens(slim: DataFrame, size: int, n_sets: int) -> np.ndarray:
    """Sorted tokens that a sample of rows shows to be in about MIN_HOT sets or more."""
    if n_sets < MIN_HOT:
        return np.empty(0, np.uint64)
    rate = min(1.0, SEEN / MIN_HOT)

    def tokens(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                short, counts = np.unique(shingle_sets(b, size)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), pa.array(counts)], names=["token", "n"])

    sample = slim.where(F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("text")
    # a token at MIN_HOT is missed once in a thousand times, one at twice as much never
    counted = sample.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, rate * MIN_HOT * 5 / 8))
    return np.sort(np.array([r.token for r in counted.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).select("token").collect()], np.int64).view(np.uint64))


def _screened(size: int, percent: int, parts: int, bits: int, hot, split: np.ndarray):
    """Texts in; the screen's token values out, packed by range with their rows in the flush, and a list of its sets for each flush."""
    share = min(1.0, max(1 / 16, SCREEN * (100 - percent) / 100))
    limit, shift = np.uint64(min(2**64 - 1, int(share * 2.0**53) << 11)), np.uint64(64 - bits)
    names = [x.split()[0] for x in _SCREENED.split(", ")]

    def row(part, block, *blobs):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def flush(number, tokens, owners, sets, sizes):
        block = (TaskContext.get().partitionId() << 20) + number
        tokens, owners, sets, sizes = map(np.concatenate, (tokens, owners, sets, sizes))
        once = np.zeros(len(sets), bool)  # copies of a set are sent once
        once[np.unique(sets, return_index=True)[1]] = True
        new = once[owners]
        tokens, owners = tokens[new], (np.cumsum(once) - 1)[owners[new]].astype(np.uint16 if once.sum() <= 1 << 16 else np.uint32)
        sets, sizes = sets[once], sizes[once]
        # so many of the values that are sent must be shared, if the rest of the set is
        needed = np.maximum(0, np.bincount(owners, minlength=len(sets)) - (sizes - -(-percent * sizes // 100)))
        yield row(parts + block, block, sets.tobytes(), _planes(np.concatenate((needed, sizes)).astype(np.uint32)))
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        cuts = np.searchsorted(_part(tokens, parts), np.arange(parts + 1))
        tokens >>= shift
        for k in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[k], cuts[k + 1])
            yield row(int(k), block, _pack_tokens(tokens[own]), _planes(owners[own]))

    def run(batches):
        held, total, rows, number = ([], [], [], []), 0, 0, 0
        for batch in batches:
            for b in blocks(batch.column("text")):
                tokens, owner = shingle_sets(b, size)
                ids, _, counts = _set_ids(tokens, owner, b.rows, split)
                some = counts > 0
                place = np.cumsum(some) - 1 + rows
                sent = tokens < limit
                if len(hot.value):  # frequent tokens are shared anyway
                    sent &= hot.value[np.minimum(np.searchsorted(hot.value, tokens), len(hot.value) - 1)] != tokens
                for x, y in zip(held, (tokens[sent], place[owner[sent]], ids[some], counts[some]), strict=True):
                    x.append(y)
                rows += int(some.sum())
                total += int(sent.sum())
                if total + rows >= PACK:
                    yield from flush(number, *held)
                    held, total, rows, number = ([], [], [], []), 0, 0, number + 1
        if rows:
            yield from flush(number, *held)

    return run


def _screen_counts(parts: int):
    """Token values of one range in; for each flush out how many of a row's values are met more than once. Lists of sets pass as they are."""

    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= parts:
            out = [(b, True, t, o) for b, t, o in zip(*(table[c].to_pylist() for c in ("block", "tokens", "owners")), strict=True)]
        else:
            rows = range(table.num_rows)
            tokens = [_unpack_tokens(table["tokens"][k].as_buffer()) for k in rows]
            owners = [_owners(table["owners"][k].as_buffer(), len(t)).astype(np.int64) + (k << 32) for k, t in zip(rows, tokens, strict=True)]
            tokens, owners = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(tokens)
            tokens = tokens[order]
            same = np.r_[False, tokens[1:] == tokens[:-1]]
            places, counts = np.unique(owners[order[same | np.r_[same[1:], False]]], return_counts=True)
            cuts = np.searchsorted(places >> 32, np.arange(table.num_rows + 1))
            out = []
            for k in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[k], cuts[k + 1])
                out.append((table["block"][int(k)].as_py(), False, _planes((places[own] & 0xFFFFFFFF).astype(np.uint32)), _planes(counts[own].astype(np.uint32))))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCREEN_COUNTS.split(", ")])

    return run


def _screen_passes(table: pa.Table) -> pa.Table:
    """One flush's counts in; the sets that may have a link out, with their sizes."""
    listed = table["listed"].to_pylist()
    sets = np.frombuffer(table["owners"][listed.index(True)].as_buffer(), np.int64)
    needed, sizes = _unplanes(table["counts"][listed.index(True)].as_buffer(), np.uint32).astype(np.int64).reshape(2, -1)
    shared = np.zeros(len(sets), np.int64)
    for k, own in enumerate(listed):
        if not own:
            shared[_unplanes(table["owners"][k].as_buffer(), np.uint32)] += _unplanes(table["counts"][k].as_buffer(), np.uint32)
    good = shared >= needed
    return pa.table([pa.array(sets[good]), pa.array(sizes[good])], names=["set_id", "n"])


def _slot_bits(ids: np.ndarray) -> list[np.ndarray]:
    """The two bits of its slot that a set has."""
    value = mix(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    return [((value >> np.uint64(at)) % np.uint64(SLOT_BITS)).astype(np.int64) for at in (0, 32)]


def _fill(slots: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["set_id"].to_numpy()
        bits = np.zeros(SLOT_BITS, np.uint8)
        for at in _slot_bits(ids):
            bits[at] = 1
        return pa.table([pa.array([int(ids[0] % slots)]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["slot", "bits"])

    return run


def _passes(kept: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which sets the filter lets pass; all, if it has no slots."""
    good = np.ones(len(ids), bool)
    if len(kept):
        for at in _slot_bits(ids):
            good &= (kept[ids % len(kept), at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return good


def _screen(slim: DataFrame, size: int, percent: int, tokens: int, hot, split: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter of the sets that may have a link, and about how many of all ``tokens`` it lets pass."""
    parts = max(1, math.ceil(tokens / GROUP_TOKENS))
    bits = min(64, tokens.bit_length() + SPARE_BITS)
    counts = slim.select("text").mapInArrow(_screened(size, percent, parts, bits, hot, split), _SCREENED).groupBy("part").applyInArrow(_screen_counts(parts), _SCREEN_COUNTS)
    passed = store.written(counts.groupBy("block").applyInArrow(_screen_passes, "set_id long, n long").distinct(), "screened-sets")
    n, sent = passed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n * FEW > SLOT_BITS * MAX_SLOTS:
        return np.empty((0, SLOT_BITS // 8), np.uint8), tokens
    slots = min(MAX_SLOTS, max(1, math.ceil(n * SET_BITS / SLOT_BITS)))
    kept = np.zeros((slots, SLOT_BITS // 8), np.uint8)
    for r in store.again(passed).groupBy(F.pmod("set_id", F.lit(slots))).applyInArrow(_fill(slots), "slot long, bits binary").collect():
        kept[r.slot] = np.frombuffer(r.bits, np.uint8)
    store.drop(passed)
    wrong = (np.bitwise_count(kept).sum() / (8 * kept.size)) ** 2
    return kept, int(sent + wrong * max(0, tokens - sent))


def _owners(raw: bytes, n: int) -> np.ndarray:
    return _unplanes(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _postings(size: int, parts: int, hot, split: np.ndarray, kept):
    def flush(number, tokens, owners, sets, sizes):
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        sets, sizes = np.concatenate(sets), np.concatenate(sizes).astype(np.uint32)
        once = np.zeros(len(sets), bool)  # copies of a set are sent once
        once[np.unique(sets, return_index=True)[1]] = True
        tokens, owners = tokens[once[owners]], owners[once[owners]]
        order = np.argsort(tokens)
        short, owners = tokens[order], owners[order]
        del tokens, order
        where = _part(short, parts)
        if len(hot.value) and len(short):
            at = np.minimum(np.searchsorted(hot.value, short), len(hot.value) - 1)
            # a group of its own for the frequent tokens of each flush
            where = np.where(hot.value[at] == short, parts, where)
            order = np.argsort(where, kind="stable")
            short, owners, where = short[order], owners[order], where[order]
        cuts = np.searchsorted(where, np.arange(parts + 2))
        for k in np.flatnonzero(np.diff(cuts)):
            own = owners[cuts[k] : cuts[k + 1]]
            used, code = np.unique(own, return_inverse=True)
            code = code.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
            blobs = [_pack_tokens(short[cuts[k] : cuts[k + 1]]), _planes(code), sets[used].tobytes(), _planes(sizes[used])]
            group = int(k) if k < parts else parts + (TaskContext.get().partitionId() << 20) + number
            yield pa.RecordBatch.from_arrays([pa.array([group]), *(pa.array([x], pa.binary()) for x in blobs)], names=[x.split()[0] for x in _PACKED.split(", ")])

    def run(batches):
        held, total, rows, number = ([], [], [], []), 0, 0, 0
        for batch in batches:
            for b in blocks(batch.column("text")):
                tokens, owner = shingle_sets(b, size)
                ids, _, counts = _set_ids(tokens, owner, b.rows, split)
                good = _passes(kept.value, ids)
                mine, place = good[owner], np.cumsum(good) - 1 + rows
                for x, y in zip(held, (tokens[mine], place[owner[mine]].astype(np.uint32), ids[good], counts[good]), strict=True):
                    x.append(y)
                total, rows = total + int(mine.sum()), rows + int(good.sum())
                if total >= PACK:
                    yield from flush(number, *held)
                    held, total, rows, number = ([], [], [], []), 0, 0, number + 1
        if total:
            yield from flush(number, *held)

    return run


def _shared(parts: int):
    """Postings of one range of tokens in, those of tokens that several sets hold out, packed by range of set."""

    def run(table: pa.Table) -> pa.Table:
        frequent = table["part"][0].as_py() >= parts
        lengths = [len(x.as_buffer()) // 8 for x in table["tokens"]]
        ends = np.cumsum(lengths)
        tokens, sets, sizes = (np.empty(ends[-1], t) for t in (np.uint64, np.int64, np.uint32))
        for k, (n, end) in enumerate(zip(lengths, ends, strict=True)):
            raw = {c: table[c][k].as_buffer() for c in ("tokens", "owners", "sets", "sizes")}
            code = _unplanes(raw["owners"], np.uint16 if raw["owners"].size == 2 * n else np.uint32)
            at = slice(end - n, end)
            tokens[at], sets[at], sizes[at] = _unpack_tokens(raw["tokens"]), np.frombuffer(raw["sets"], np.int64)[code], _unplanes(raw["sizes"], np.uint32)[code]
        order = np.lexsort((sets, tokens))
        for x in (tokens, sets, sizes):
            x[:] = x[order]
        del order
        same = np.r_[False, tokens[1:] == tokens[:-1]]
        new = ~(same & np.r_[False, sets[1:] == sets[:-1]])
        if not frequent:  # a token of one set alone can't be shared
            new &= same | np.r_[same[1:], False]
        tokens = tokens[new]  # one after the other, so that one copy is held at a time
        sets = sets[new]
        sizes = sizes[new]
        del same, new
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
        held = np.diff(np.r_[first, len(tokens)])
        rarity = np.repeat(np.floor(4 * np.log2(np.maximum(held, 2))).astype(np.uint8), held)
        if frequent:
            rarity[:] = 255
        elif len(tokens):  # copies of one set came twice, and are one now
            many = np.repeat(held > 1, held)
            tokens, sets, sizes, rarity = tokens[many], sets[many], sizes[many], rarity[many]
        order = np.lexsort((tokens, sets))
        for x in (tokens, sets, sizes, rarity):
            x[:] = x[order]
        del order
        first = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]]) if len(sets) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[first, len(sets)]).astype(np.uint32)
        ids, own = sets[first], sizes[first]
        where = _part(mix(ids.view(np.uint64)), parts)
        out = []
        for k in np.unique(where):
            mine = where == k
            take = np.repeat(mine, lengths)
            short = tokens[take]
            blobs = [_planes(short), rarity[take].tobytes(), ids[mine].tobytes(), _planes(own[mine]), _planes(lengths[mine])]
            out.append([int(k), *blobs])
        names = [x.split()[0] for x in _SHARED.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    return run


def _survive(percent: int):
    """Shared tokens of one range of sets in; sets that can have a link out, with their prefix tokens and bitmap."""

    def run(table: pa.Table) -> pa.Table:
        tokens, rarity, owner, size = [], [], [], []
        for t, c, s, z, m in zip(*(table[c].to_pylist() for c in ("tokens", "counts", "sets", "sizes", "lengths")), strict=True):
            tokens.append(_unplanes(t, np.uint64))
            rarity.append(np.frombuffer(c, np.uint8))
            lengths = _unplanes(m, np.uint32)
            owner.append(np.repeat(np.frombuffer(s, np.int64), lengths))
            size.append(np.repeat(_unplanes(z, np.uint32), lengths))
        tokens, rarity, owner, size = map(np.concatenate, (tokens, rarity, owner, size))
        order = np.lexsort((tokens, owner))
        tokens, rarity, owner, size = tokens[order], rarity[order], owner[order], size[order]
        # a set that several tasks met may bring a frequent token more than once
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])] if len(tokens) else np.empty(0, bool)
        tokens, rarity, owner, size = tokens[new], rarity[new], owner[new], size[new]
        ids, code, counts = np.unique(owner, return_inverse=True, return_counts=True)
        n = np.zeros(len(ids), np.int64)
        n[code] = size
        prefix = n - -(-percent * n // 100) + 1
        left = prefix - (n - counts)  # prefix places that tokens of this set alone leave
        cuts = np.r_[0, np.cumsum(counts)]
        rows = []
        for k in np.flatnonzero(left > 0):
            own, rare = tokens[cuts[k] : cuts[k + 1]], rarity[cuts[k] : cuts[k + 1]]
            bits = np.zeros(BITS, np.uint8)
            bits[(own % BITS).astype(np.int64)] = 1
            first = own[np.lexsort((own, rare))[: left[k]]]
            rows.append((int(ids[k]), int(n[k]), own.tobytes(), first.view(np.int64), np.packbits(bits).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["set_id", "n", "tokens", "prefix", "bits"])

    return run


def _linked(percent: int):
    """Pairs with both sets' tokens in, those that link out."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("tokens_a"), batch.column("tokens_b")
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
            good = np.zeros(batch.num_rows, bool)
            for k, (n, m) in enumerate(sizes):
                both = len(np.intersect1d(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64), assume_unique=True))
                good[k] = 100 * both >= percent * (n + m - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return run


def verified(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that link, by exact overlap.

    Survivors lie in buckets by set: pairs go to them, and tokens are shuffled once, those of a to the bucket of b.
    """
    s, t = (survivors.select(F.col("set_id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    joined = pairs.join(s, F.col("a") == F.col("id_a")).join(t, F.col("b") == F.col("id_b")).select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
    return joined.mapInArrow(_linked(percent), "a long, b long")


class Forest:
    """Signature trees of many buckets at once: levels of nodes with OR-combined bitmaps, size ranges, classes and sides."""

    def __init__(self, bucket, size, excess, label, side, bits):
        """Members, sorted by bucket; bits: rows of packed bitmaps."""
        self.levels = [dict(bucket=bucket, low=size, high=size, excess=excess, label=label, pure=np.ones(len(bucket), bool), side=side, one_side=np.ones(len(bucket), bool), bits=bits, first=None)]
        while len(np.unique(self.levels[-1]["bucket"])) < len(self.levels[-1]["bucket"]):
            x = self.levels[-1]
            begin = np.flatnonzero(np.r_[True, x["bucket"][1:] != x["bucket"][:-1]])
            place = np.arange(len(x["bucket"])) - np.repeat(begin, np.diff(np.r_[begin, len(x["bucket"])]))
            first = np.flatnonzero(place % FAN == 0)
            same = lambda key, ok: (np.minimum.reduceat(x[key], first) == np.maximum.reduceat(x[key], first)) & np.logical_and.reduceat(x[ok], first)  # noqa: B023, E731
            self.levels.append(dict(bucket=x["bucket"][first], low=np.minimum.reduceat(x["low"], first), high=np.maximum.reduceat(x["high"], first), excess=np.maximum.reduceat(x["excess"], first), label=x["label"][first], pure=same("label", "pure"), side=x["side"][first], one_side=same("side", "one_side"), bits=np.bitwise_or.reduceat(x["bits"], first, axis=0), first=np.r_[first, len(x["bucket"])]))

    def possible(self, level: int, a, b, percent: int) -> np.ndarray:
        """Which pairs of a level's nodes may hold a link between classes."""
        x = self.levels[level]
        keep = (100 * x["high"][a] >= percent * x["low"][b]) & (100 * x["high"][b] >= percent * x["low"][a])
        keep &= ~(x["pure"][a] & x["pure"][b] & (x["label"][a] == x["label"][b]))
        keep &= ~(x["one_side"][a] & x["one_side"][b] & (x["side"][a] == x["side"][b]) & (x["side"][a] >= 0))
        at = np.flatnonzero(keep)
        common = np.bitwise_count(x["bits"][a[at]] & x["bits"][b[at]]).sum(axis=1, dtype=np.int64)
        overlap = common + np.minimum(x["excess"][a[at]], x["excess"][b[at]])
        keep[at] = (100 + percent) * overlap >= percent * (x["low"][a[at]] + x["low"][b[at]])
        return keep

    def pairs(self, percent: int):
        """Pairs of members that the dual traversal can't rule out."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["bucket"]))
        stack = [(top, roots[k : k + PAIRS], roots[k : k + PAIRS]) for k in range(0, len(roots), PAIRS)]
        while stack:
            level, a, b = stack.pop()
            keep = self.possible(level, a, b, percent)
            if level == 0:
                keep &= a != b
                yield a[keep], b[keep]
                continue
            a, b = a[keep], b[keep]
            first = self.levels[level]["first"]
            grid = np.arange(FAN * FAN)
            left, right = first[a][:, None] + grid // FAN, first[b][:, None] + grid % FAN
            good = (left < first[a + 1][:, None]) & (right < first[b + 1][:, None]) & ((a != b)[:, None] | (left <= right))
            left, right = left[good], right[good]
            stack += [(level - 1, left[k : k + PAIRS], right[k : k + PAIRS]) for k in range(0, len(left), PAIRS)]


def _trees(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        cell, n, label, side, ids = (table[c].to_numpy() for c in ("cell", "n", "label", "side", "set_id"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        shared = table["shared"].to_numpy()
        del table
        order = np.lexsort((ids, n, label, side, cell))
        order = order[np.lexsort((n[order], cell[order]))] if (side < 0).all() else order
        bits, ids, shared = bits[order], ids[order], shared[order]
        excess = shared - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        forest = Forest(cell[order], n[order], excess, label[order], side[order].astype(np.int64), bits)
        for a, b in forest.pairs(percent):
            pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _tree_candidates(survivors: DataFrame, labels: DataFrame, percent: int, postings: int) -> DataFrame:
    """Pairs of sets of different classes that share a bucket and that no tree rules out."""
    s = survivors.select("set_id", "n", "bits", (F.length("tokens") / 8).cast("long").alias("shared"), "prefix")
    named = s.join(labels.select(F.col("node"), F.col("root")), F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "set_id")).drop("node", "root")
    spread = named.withColumn("token", F.explode("prefix")).drop("prefix")
    buckets = spread.groupBy("token").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    buckets = store.written(buckets.where("low <> high").select(F.col("token").alias("bucket"), "members"), "open-buckets")
    members = store.written(split_join(spread, buckets, {"token": "bucket"}, "members", postings).drop("bucket"), "tree-members")
    in_cells = store.again(buckets).agg(F.coalesce(F.sum(F.col("members") * F.ceil(F.col("members") / BUCKET)), F.lit(0))).first()[0]
    groups = max(1, math.ceil(in_cells / GROUP_POSTINGS))
    cells = F.ceil(F.col("members") / BUCKET).cast("long")
    own = F.pmod(F.xxhash64("set_id"), cells)
    other = F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))
    grid = members.withColumn("cells", cells).withColumn("own", own).withColumn("other", other)
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own"))
    grid = grid.select("set_id", "n", "bits", "shared", "label", cell.alias("cell"), side.alias("side")).withColumn("part", F.pmod("cell", F.lit(groups)))
    return grid.groupBy("part").applyInArrow(_trees(percent), "a long, b long").distinct()


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


class Classes:
    """Near-duplicate classes of the rows of ``docs``.

    sets: doc_id, text_key (hash of the text), set_id, twin, n_shingles of every row; total: how many.
    per_set: set_id, copies (rows that have the set), first (the smallest row: none, doc_id, text_key), class_id of each set.
    heads: key (class_id), head (smallest row of the class), of_sets (sets of the class).
    """

    def __init__(self, docs: DataFrame, size: int = SIZE, percent: int = PERCENT):
        spark = docs.sparkSession
        slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key().alias("text_key"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
        split = np.empty(0, np.int64)
        while True:
            self.sets = store.written(slim.mapInArrow(_sets(size, split), _SETS), "shingle-sets")
            known = self.sets.where("n_shingles > 0").groupBy("set_id").agg(first, F.count("*").alias("copies"), F.min("twin").alias("low"), F.max("twin").alias("high"))
            known = store.written(known, "distinct-sets")
            # among N sets about N^2 / 2^65 ids stand for two sets: a handful at ten billion
            doubtful = np.array([r.set_id for r in known.where("low <> high").select("set_id").collect()], np.int64)
            if not len(doubtful):
                break
            split = np.union1d(split, doubtful)
        self.total, tokens = self.sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        hot = spark.sparkContext.broadcast(_hot_tokens(slim, size, self.total))
        kept, sent = _screen(slim, size, percent, tokens, hot, split)
        parts, kept = max(1, math.ceil(sent / GROUP_TOKENS)), spark.sparkContext.broadcast(kept)

        packed = slim.select("text").mapInArrow(_postings(size, parts, hot, split, kept), _PACKED)
        shared = packed.groupBy("part").applyInArrow(_shared(parts), _SHARED)
        buckets = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(8 * tokens / BUCKET_BYTES)))
        whole = shared.groupBy("part").applyInArrow(_survive(percent), _SURVIVORS)
        survivors = store.bucketed(whole.repartition(buckets, "set_id"), "join-survivors", "set_id", buckets)  # a file for each bucket
        postings = survivors.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]

        links = store.written(verified(_star_pairs(survivors, postings), survivors, percent), "star-links")
        labels = store.written(connected_components(links, "star-rounds"), "star-labels")
        more = verified(_tree_candidates(survivors, labels, percent, postings), survivors, percent)
        edges = store.again(links).unionByName(more)
        classes = store.written(connected_components(edges, "class-rounds"), "set-classes")
        store.drop(survivors)

        named = store.again(known).join(classes, F.col("set_id") == F.col("node"), "left").select("set_id", "copies", "first", F.coalesce("root", "set_id").alias("class_id"))
        self.per_set = store.written(named, "classed-sets")
        self.heads = store.written(self.per_set.groupBy(F.col("class_id").alias("key")).agg(F.min("first").alias("head"), F.count("*").alias("of_sets")), "class-heads")
        self.n_sets = self.per_set.count()


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null, empty or blank text: no shingles, linked with nothing, its own component. A null doc_id has no
    place among the ids: component_id is the smallest other id of its component, or null. Repeated
    rows are exact copies. Texts may have any length: a task holds one whole, with two numbers for each of its words.
    A pair exactly at the threshold links. Extra columns are ignored; an empty table gives an empty result.
    """
    c = Classes(docs, size, percent)
    smallest = split_join(store.again(c.per_set), c.heads, {"class_id": "key"}, "of_sets", c.n_sets)
    smallest = store.written(smallest.select(F.col("set_id").alias("key"), "copies", F.col("head.doc_id").alias("smallest")), "set-heads")
    worded, blank = (store.again(c.sets).where(x) for x in ("n_shingles > 0", "n_shingles = 0"))
    found = split_join(worded, smallest, {"set_id": "key"}, "copies", c.total)
    return found.select("doc_id", "n_shingles", F.col("smallest").alias("component_id")).unionByName(blank.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, that of the smallest id (null last), with all its columns.

    Rows without shingles all stay, except that rows that repeat an id and its text are one document. Long texts,
    ties and empty tables as in :func:`near_duplicates`; columns of any name stay as they are.
    """
    c = Classes(docs, size, percent)
    chosen = c.heads.select(F.col("head.doc_id").alias("_nj_id"), F.col("head.text_key").alias("_nj_key"))
    blank = store.again(c.sets).where("n_shingles = 0").select(F.col("doc_id").alias("_nj_id"), F.col("text_key").alias("_nj_key"))
    keyed = docs.withColumn("_nj_text", _text_key()).withColumn("_nj_doc", F.col("doc_id").cast("long"))
    met = keyed.join(chosen.unionByName(blank), (F.col("_nj_text") == F.col("_nj_key")) & F.col("_nj_doc").eqNullSafe(F.col("_nj_id")), "left_semi")
    return met.dropDuplicates(["_nj_text", "_nj_doc"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def _star_pairs(survivors: DataFrame, postings: int) -> DataFrame:
    """(a, b): each set with the hub of most of its buckets, if that is another set."""
    # tokens of its own take prefix places from a set: the more are left, the nearer it is to a group's middle
    left = (F.size("prefix") / F.col("n")).alias("left")
    p = survivors.select("set_id", F.explode("prefix").alias("token"))
    q = survivors.select("set_id", left, F.explode("prefix").alias("bucket"))
    hubs = q.groupBy("bucket").agg(F.max(F.struct("left", "set_id")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = store.written(hubs.select("bucket", "members", F.col("hub.left").alias("left"), F.col("hub.set_id").alias("hub")), "bucket-hubs")
    met = split_join(p, hubs, {"token": "bucket"}, "members", postings).groupBy("set_id", "hub").agg(F.count("*").alias("times"), F.max("left").alias("left"))
    best = met.where("set_id <> hub").groupBy("set_id").agg(F.max(F.struct("times", "left", "hub")).alias("best"))
    return best.select(F.col("set_id").alias("a"), F.col("best.hub").alias("b"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate classes of the whole ``documents`` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT row_id, list_slice(ws, i, i + {SIZE - 1}) AS s FROM (SELECT row_id, ws, unnest(range(1, greatest(2, len(ws) - {SIZE - 2}))) AS i FROM d WHERE len(ws) > 0)),
h AS (SELECT row_id, md5(array_to_string(s, ' ')) AS s FROM g),
n AS (SELECT row_id, count(*) AS n FROM h GROUP BY row_id),
p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.row_id <> b.row_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.row_id = x JOIN n b ON b.row_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
reach AS (SELECT row_id AS x, row_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
k AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.row_id = reach.y GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN k ON k.x = d.row_id LEFT JOIN n USING (row_id)
"""
