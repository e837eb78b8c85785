"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's dimensions are cut into m slices, the nodes of the method: each has its own list of partial
scores, and a score is the sum of m of them. Rows are packed once into blocks of one norm band each, which stay where they
are; queries come to them in waves of WAVE components at most, as a broadcast of that size:
1. gather: on every PROBE-th block of rows each slice names, for each query, the k rows with its highest
   partial scores; only their scores are made. A task keeps the k best of all its blocks, tasks' lists are merged, and
   their k-th best is a safe cutoff, since k rows reach it whatever the other rows hold;
2. collect: a row that reaches the cutoff must have a partial score of cutoff / m or more in some slice, so
   each slice sends those entries only. Rows whose norms can't reach any cutoff are passed over; so
   is a row whose known partial scores plus the bounds of the others (the uniform threshold, or the product
   of the slices' norms where that is less) stay below the cutoff;
3. resolve: the missing partial scores of the rows that are left are looked up, and the k best of each
   task that reach the cutoff are ranked. A task's own k-th best raises its cutoffs as it goes.

Every vector takes part; cutoffs and bounds only decide what need not be looked at further. All scores are exact
integers: products are made in the smallest type that holds them. Rows are told apart by their place, never by their id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

K, SCALE, EVERY, SLICES = 20, 64, 20, 2
#: Components in one block of rows and in one wave of queries; rows and queries of one product; every how many blocks of rows the gathering looks at.
ROW_BLOCK, WAVE, TILE_ROWS, TILE_QUERIES, PROBE = 1 << 23, 1 << 23, 8_192, 512, 4
#: A band holds norms within a factor of 2 ** (1 / BANDS).
BANDS = 4

_PACKED = "block long, ids binary, matrix binary, kind string, width int"
_FOUND = "query_id long, vec_id long, score long"
_LISTS = "tile int, scores binary"
_LOW = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * component) as double, of vectors without null or non-finite components.

    Rows without vec_id or vector take no part; repeated rows, and rows that repeat an id with another vector, all do.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    if not len(lists):
        return np.zeros((0, width), np.int64)
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _smallest_kind(values: np.ndarray) -> str:
    """The smallest integer type that holds the values."""
    most = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    return next(k for k in ("i1", "i2", "i4", "i8") if most <= np.iinfo(k).max)


def _pack(table: pa.Table) -> pa.Table:
    """All vectors of a block as one row."""
    width = max(1, int(table["v"].combine_chunks().value_lengths().to_numpy().max(initial=0)))
    v = _matrix(table["v"], width)
    kind = _smallest_kind(v)
    columns = [[table["block"][0].as_py()], [table["vec_id"].to_numpy().tobytes()], [v.astype(kind).tobytes()], [kind], [width]]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _blocks(batches, width: int):
    """Ids and vectors, ended by zeros up to ``width``, of each block."""
    for batch in batches:
        for ids, matrix, kind, own in zip(*(batch.column(c) for c in ("ids", "matrix", "kind", "width")), strict=True):
            v = np.frombuffer(matrix.as_buffer(), kind.as_py()).reshape(-1, own.as_py())
            yield np.frombuffer(ids.as_buffer(), np.int64), np.pad(v, ((0, 0), (0, width - v.shape[1]))) if v.shape[1] < width else v


class Slices:
    """A block of rows and one of queries, cut into slices of dimensions; ``resolved`` counts the scores that were made."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, slices: int):
        width = rows.shape[1]
        most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * width
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        cuts = np.array_split(np.arange(width), min(slices, width))
        self.rows, self.queries = ([np.ascontiguousarray(x[:, c], self.kind) for c in cuts] for x in (rows, queries))
        # a little above the norms, so that rounding never makes a bound too small
        norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.row_norms, self.query_norms = ([norm(x) for x in side] for side in (self.rows, self.queries))
        self.resolved = 0

    def whole_norms(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.sqrt(sum(n**2 for n in side)) * (1 + 1e-9) for side in (self.row_norms, self.query_norms))

    def partials(self, q: slice, r: slice) -> list[np.ndarray]:
        """Each slice's partial scores of some queries and rows."""
        return [a[q] @ b[r].T for a, b in zip(self.queries, self.rows, strict=True)]

    def resolve(self, parts: list[np.ndarray], at_query: np.ndarray, at_row: np.ndarray) -> np.ndarray:
        self.resolved += len(at_query)
        return sum(p[at_query, at_row].astype(np.int64) for p in parts)

    def gathered(self, q: slice, r: slice, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and scores of the rows that each slice names: the k with its highest partial scores."""
        parts = self.partials(q, r)
        named = np.zeros(own.shape, bool)
        for p in parts:
            least = min(k, p.shape[1])
            np.put_along_axis(named, np.argpartition(p, -least, axis=1)[:, -least:], True, axis=1)
        at_query, at_row = np.nonzero(named & ~own)
        return at_query, self.resolve(parts, at_query, at_row)

    def reaching(self, q: slice, r: slice, own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and scores of the pairs that reach the cutoff."""
        parts = self.partials(q, r)
        threshold = cutoff / len(parts)
        sent = np.zeros(own.shape, bool)
        for p in parts:
            sent |= p >= threshold[:, None]
        sent &= ~own
        at_query, at_row = np.nonzero(sent)
        bound = np.zeros(len(at_query))
        for p, a, b in zip(parts, self.query_norms, self.row_norms, strict=True):
            known = p[at_query, at_row].astype(np.float64)
            other = np.minimum(threshold[at_query], a[q][at_query] * b[r][at_row])
            bound += np.where(known >= threshold[at_query], known, other)
        left = bound >= cutoff[at_query] - 1e-6 * np.abs(cutoff[at_query])
        at_query, at_row = at_query[left], at_row[left]
        score = self.resolve(parts, at_query, at_row)
        reach = score >= cutoff[at_query]
        return at_query[reach], at_row[reach], score[reach]


def _tiles(n: int, size: int):
    return [slice(k, min(k + size, n)) for k in range(0, n, size)]


def _best(at_query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query; ties to the smaller id."""
    order = np.lexsort((ids, -score, at_query))
    ordered = at_query[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def _no_more(score: np.ndarray) -> np.ndarray:
    """Scores as floats that are not above them."""
    out = score.astype(np.float64)
    return np.where(np.abs(out) < 1 << 53, out, np.nextafter(out, -np.inf))


def _gather(wave, k: int, slices: int):
    """Blocks of rows in; for each tile of queries the k best of the scores that slices name out."""

    def run(batches):
        qs, q = wave.value
        best, any_ = np.full((len(qs), k), _LOW), False
        for ids, r in _blocks(batches, q.shape[1]):
            meet, any_ = Slices(r, q, slices), True
            for a in _tiles(len(qs), TILE_QUERIES):
                for b in _tiles(len(ids), TILE_ROWS):
                    at, score = meet.gathered(a, b, qs[a, None] == ids[None, b], k)
                    order = np.lexsort((-score, at))
                    place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
                    top = place < k
                    more = np.full((a.stop - a.start, k), _LOW)
                    more[at[order][top], place[top]] = score[order][top]
                    best[a] = np.sort(np.concatenate([best[a], more], axis=1), axis=1)[:, -k:]
        if any_:
            for n, a in enumerate(_tiles(len(qs), TILE_QUERIES)):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([best[a].tobytes()])], names=["tile", "scores"])

    return run


def _cutoffs(k: int):
    """All tasks' lists of one tile of queries in; the k-th best of each query out (the least number, where there is none)."""

    def run(table: pa.Table) -> pa.Table:
        lists = np.concatenate([np.frombuffer(s.as_buffer(), np.int64).reshape(-1, k) for s in table["scores"]], axis=1)
        return pa.table([table["tile"].slice(0, 1), pa.array([np.partition(lists, -k, axis=1)[:, -k].tobytes()], pa.binary())], names=["tile", "scores"])

    return run


def _collect(wave, cutoffs, k: int, slices: int):
    """Blocks of rows in; each query's k best that reach its cutoff out."""

    def run(batches):
        (qs, q), cutoff = wave.value, cutoffs.value.copy()
        found = (np.empty(0, np.int64),) * 3
        for ids, r in _blocks(batches, q.shape[1]):
            meet, parts = Slices(r, q, slices), [found]
            row_norms, query_norms = meet.whole_norms()
            for a in _tiles(len(qs), TILE_QUERIES):
                for b in _tiles(len(ids), TILE_ROWS):
                    if (query_norms[a] * row_norms[b].max(initial=0) < cutoff[a]).all():
                        continue
                    at, row, score = meet.reaching(a, b, qs[a, None] == ids[None, b], cutoff[a])
                    parts.append((at + a.start, ids[b][row], score))
            at, vec, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            best = _best(at, vec, score, k)
            found = at[best], vec[best], score[best]
            # entries lie by query, best first: a query's k-th is the least that still counts
            last = np.flatnonzero(np.arange(len(best)) - np.searchsorted(found[0], found[0]) == k - 1)
            cutoff[found[0][last]] = np.maximum(cutoff[found[0][last]], _no_more(found[2][last]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qs[found[0]], found[1], found[2])], names=["query_id", "vec_id", "score"])

    return run


def _packed(table: DataFrame, per_block: int, least_blocks: int) -> DataFrame:
    """``table`` (row, vec_id, v, band) in blocks of about ``per_block`` vectors of one band; blocks are numbered from 0."""
    sizes = [(r.band, r.n) for r in table.groupBy("band").agg(F.count("*").alias("n")).orderBy("band").collect()]  # a row for each band of norms
    total = sum(n for _, n in sizes)
    per_block = max(1, min(per_block, math.ceil(total / least_blocks)))
    plan, first = [], 0
    for band, n in sizes:
        plan.append((band, first, max(1, math.ceil(n / per_block))))
        first += plan[-1][2]
    bands = F.broadcast(table.sparkSession.createDataFrame(plan, "of long, first long, blocks long"))
    placed = table.join(bands, F.col("band") == F.col("of")).select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).alias("block"))
    return store.written(placed.groupBy("block").applyInArrow(_pack, _PACKED), "topk-rows")


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest integer inner product for each query.

    ``vectors``: vec_id, embedding. Queries: vec_id divisible by ``every``; candidates: all rows but those of
    the query's id. Ties go to the smaller vec_id; with fewer candidates, all. Rows with a null id or vector, or with
    null or non-finite components, take no part. Repeated rows, and several vectors of one id, are so many candidates; as
    queries they are ranked together. Shorter vectors count as ending in zeros; scores must fit 64 bits. Vectors may have any length:
    blocks hold fewer of them. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    table = integer_vectors(vectors, scale).withColumn("band", F.when(norm > 0, F.floor(F.log2(norm) / 2 * BANDS)).otherwise(-1).cast("long"))
    table = store.written(table.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    n, n_queries, width = table.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    spare = max(1, min(2 * spark.sparkContext.defaultParallelism, n // 1_024))
    rows = _packed(store.again(table), max(1, ROW_BLOCK // width), spare)
    blocks = rows.agg(F.max("block")).first()[0] + 1
    waves, found = math.ceil(n_queries * width / WAVE), []
    lists = store.again(rows).where(F.col("block") % (PROBE if blocks >= PROBE else 1) == 0)
    for number in range(waves):
        some = store.again(table).where(is_query & (F.pmod(F.xxhash64("row"), F.lit(waves)) == number)).select("vec_id", "v").toArrow()  # WAVE components or so
        asked = _matrix(some["v"], width)
        wave = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), asked.astype(_smallest_kind(asked))))
        merged = lists.mapInArrow(_gather(wave, k, slices), _LISTS).groupBy("tile").applyInArrow(_cutoffs(k), _LISTS).collect()  # a number for each query of the wave
        least = np.concatenate([np.frombuffer(r.scores, np.int64) for r in sorted(merged, key=lambda r: r.tile)]) if merged else np.full(len(asked), _LOW)
        cutoffs = spark.sparkContext.broadcast(np.where(least == _LOW, -np.inf, _no_more(least)))
        found.append(rows.mapInArrow(_collect(wave, cutoffs, k, slices), _FOUND))
        if waves > 1:  # so that one wave is held at a time
            found[-1] = store.written(found[-1], "topk-wave")
            wave.destroy()
            cutoffs.destroy()
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest rows of every twentieth row of the whole ``embeddings`` table."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
