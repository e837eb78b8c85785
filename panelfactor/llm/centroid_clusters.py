"""Centroid clustering with partial-distance search.

Vectors become integers and are written once as packed blocks. Each round is one pass over the blocks: a
task gets the k centroids (a model of fixed size), finds each vector's nearest and returns, for each
cluster, a count and exact component sums; Spark adds them up, and the driver sees k rows.

The search of the nearest centroid takes the components in order of falling variance (measured over all
vectors), a few at a time. After the first few, the centroid with the smallest sum so far is finished for each
vector: its distance is the current best. A centroid whose sum is strictly above the best is abandoned, the
others go on, and those that are left have all components when they are compared. Sums only grow, so
nothing nearest is abandoned; ties go to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

CENTROIDS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, 2
#: Components in one step of a search; vectors that are searched at once.
STEP, TILE = 8, 2_048
#: Integers beyond this have squared distances that 64 bits may not hold.
LARGEST = 1 << 27

_PACKED = "ids array<long>, matrix binary, kind string"
_FOUND = "vec_id long, cluster int, distance long"
_SUMS = "cluster int, place int, n long, total long"


def integer_matrix(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (``width`` components, none null or not finite), and floor(scale * x) of those."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    right = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is nan here
    rows = flat.reshape(-1, width)
    good = np.isfinite(rows).all(axis=1)
    values = np.floor(rows[good] * scale)
    if np.abs(values).max(initial=0) > LARGEST:
        raise ValueError(f"components times {scale} must lie within {LARGEST}")
    return right[good], values.astype(np.int64)


def _pack(width: int, scale: int):
    def run(batches):
        for batch in batches:
            kept, values = integer_matrix(batch.column("embedding"), width, scale)
            if len(kept):
                kind = next(k for k in ("i2", "i4") if np.abs(values).max() <= np.iinfo(k).max)
                ids = batch.column("vec_id").take(pa.array(kept)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([values.astype(kind).tobytes()]), pa.array([kind])], names=["ids", "matrix", "kind"])

    return run


def _blocks(batches, width: int):
    """Ids and vectors of each packed block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("ids").slice(k, 1).flatten(), np.frombuffer(batch.column("matrix")[k].as_buffer(), batch.column("kind")[k].as_py()).reshape(-1, width)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; ``order`` is that in which components are taken."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.int32 if len(order) * (2 * most) ** 2 < 1 << 31 else np.int64
    c = centroids[:, order].astype(kind)
    number, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
    for lo in range(0, len(vectors), TILE):
        v = vectors[lo : lo + TILE][:, order].astype(kind)
        so_far = np.zeros((len(v), len(c)), kind)
        for place in range(min(step, len(order))):
            so_far += (v[:, place, None] - c[None, :, place]) ** 2
        guess = so_far.argmin(axis=1)
        rest = v[:, step:] - c[guess, step:]
        best = so_far[np.arange(len(v)), guess] + (rest * rest).sum(axis=1, dtype=kind)
        at, to = np.nonzero(so_far <= best[:, None])
        sums = so_far[at, to]
        for first in range(step, len(order), step):
            diff = v[at, first : first + step] - c[to, first : first + step]
            sums += (diff * diff).sum(axis=1, dtype=kind)
            left = sums <= best[at]
            at, to, sums = at[left], to[left], sums[left]
        # every vector still has its guess at least; entries lie in order of vector, then centroid
        begin = np.searchsorted(at, np.arange(len(v)))
        least = np.minimum.reduceat(sums, begin)
        winner = np.flatnonzero(sums == least[at])
        winner = winner[np.unique(at[winner], return_index=True)[1]]
        number[lo : lo + len(v)], distance[lo : lo + len(v)] = to[winner], least
    return number, distance


def _spread(width: int):
    """Count, sum and sum of squares of each component (as numbers that only order them)."""

    def run(batches):
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for _, v in _blocks(batches, width):
            n, one, two = n + len(v), one + v.sum(axis=0, dtype=np.float64), two + (v.astype(np.float64) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n, np.int64)), pa.array(one), pa.array(two)], names=["place", "n", "one", "two"])

    return run


def _sums(model, width: int):
    """Count and component sums of each cluster, over one task's blocks."""

    def run(batches):
        centroids, order = model.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for _, v in _blocks(batches, width):
            number, _ = nearest(v, centroids, order)
            by = np.argsort(number, kind="stable")
            used, first = np.unique(number[by], return_index=True)
            total[used] += np.add.reduceat(v[by].astype(np.int64), first, axis=0)
            n += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(n)
        columns = [np.repeat(some, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(some)), np.repeat(n[some], width), total[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cluster", "place", "n", "total"])

    return run


def _assign(model, width: int):
    def run(batches):
        centroids, order = model.value
        for ids, v in _blocks(batches, width):
            number, distance = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids as a k x width array).

    ``vectors``: vec_id, embedding. Kept are vectors with exactly ``width`` components, none null or not finite. The
    starting centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (ties, as of repeated ids, to the smaller
    vector; null ids last); with fewer vectors there are fewer centroids. Repeated rows are vectors like others; a null id is
    clustered and returned. Integers beyond 2^27 are an error, since distances are 64 bits. Extra columns are ignored; an
    empty table, or one without a kept vector, gives no rows and no centroids.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = store.written(slim.mapInArrow(_pack(width, scale), _PACKED), "cluster-vectors")
    e = F.col("embedding")
    fit = slim.where((F.size(e) == width) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    start = fit.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    chosen = start.orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in chosen], np.int64).reshape(-1, width)
    if not len(centroids):
        return spark.createDataFrame([], _FOUND), centroids
    spread = packed.mapInArrow(_spread(width), "place int, n long, one double, two double").groupBy("place").agg(*(F.sum(x).alias(x) for x in ("n", "one", "two"))).orderBy("place").collect()
    order = np.argsort([-(r.two / r.n - (r.one / r.n) ** 2) for r in spread], kind="stable")
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((centroids, order))
        # sums beyond 64 bits are possible over all vectors, not in one task
        added = packed.mapInArrow(_sums(model, width), _SUMS).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for r in added.collect():  # k x width rows
            centroids[r.cluster, r.place] = int(r.total) // r.n
        model.unpersist()
    return packed.mapInArrow(_assign(spark.sparkContext.broadcast((centroids, order)), width), _FOUND), centroids


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Query: cluster, distance, inertias and centroid digest of every vector of the whole ``embeddings`` table."""
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = store.written(found, "clustered")
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(digests, "number int, centroid_sha256 string")
    per_cluster = found.groupBy(F.col("cluster").alias("of")).agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = per_cluster.join(F.broadcast(digests), F.col("of") == F.col("number"))  # a row for each of the k centroids
    inertia = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))  # over k rows
    named = F.broadcast(per_cluster.withColumn("inertia", inertia))
    return store.again(found).join(named, F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1)::INT AS k, v AS c FROM e ORDER BY 1 LIMIT {CENTROIDS})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT r, k, (list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT AS q FROM e, c{n})")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, k, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q, k) AS p FROM d{n}) WHERE p = 1)")
        if n < ROUNDS:
            steps.append(f"u{n} AS (SELECT k, unnest(range(1, {WIDTH + 1})) AS i, unnest(v)::HUGEINT AS x FROM a{n} JOIN e USING (r))")
            steps.append(f"m{n} AS (SELECT k, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{n} GROUP BY k, i) GROUP BY k)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (k))")
    joined = "array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, k AS cluster, q AS distance, (sum(q) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(q) OVER ())::BIGINT AS inertia, sha256({joined}) AS centroid_sha256"
        f" FROM a{ROUNDS} JOIN e USING (r) JOIN c{ROUNDS} USING (k)"
    )


OP13_SQL = _sql()
