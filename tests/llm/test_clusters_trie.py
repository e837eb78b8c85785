import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfactor.llm import centroid_clusters, prefix_trie

VECTORS = "vec_id long, embedding array<float>"


def plain_clusters(rows, k, rounds, width, scale=256):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ordered[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted([(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], key=str), centroids


@pytest.mark.parametrize(("seed", "scale"), [(1, 256), (2, 256), (3, 200_000)])
def test_clusters_equal_a_plain_version(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(centroid_clusters, "TILE", 16)
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in r.integers(-4, 5, 10) / 4]) for k in range(120)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (8, rows[9][1]), (None, rows[5][1]), (500, None), (501, [1.0] * 9), (502, [None] + [0.0] * 9), (503, [float("nan")] * 10), (504, [float("inf")] * 10), (505, []), (-3, [-0.001] * 10)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("clash")).repartition(3)
    found, centroids = centroid_clusters.clusters(table, k=7, rounds=3, width=10, scale=scale)
    want, final = plain_clusters(rows, 7, 3, 10, scale)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert centroids.tolist() == final


@pytest.mark.parametrize("step", [1, 3, 8, 64])
def test_partial_distances_lose_no_nearest(step):
    r = np.random.default_rng(step)
    v, c = r.integers(-3, 4, (500, 12)), r.integers(-3, 4, (40, 12))
    number, distance = centroid_clusters.nearest(v, c, r.permutation(12), step)
    whole = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_few_vectors_and_none(spark):
    found, centroids = centroid_clusters.clusters(spark.createDataFrame([(1, [0.5] * 64), (1, [0.25] * 64)], VECTORS))
    assert len(centroids) == 2 and sorted((r.vec_id, r.distance) for r in found.collect()) == [(1, 0), (1, 0)]
    found, centroids = centroid_clusters.clusters(spark.createDataFrame([(1, [0.5])], VECTORS))
    assert found.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="must lie within"):
        centroid_clusters.clusters(spark.createDataFrame([(1, [1e30] * 64)], VECTORS))


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, group=100, heads=6):
    own = {}
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, group))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        ends = sorted(c for c in cs if len(whole[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(kids.get(key, [])), sum(k not in kids for k in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = np.random.default_rng(seed)
    rows = []
    for c in [*range(60), *range(200, 230), *range(330, 360), -1, -150, -100, 10**12]:
        for t in range(int(r.integers(1, 9))):
            rows.append((int(c), t, str(r.choice(["user", "bot"])), "é" * int(r.integers(0, 3))))
    rows += [(3, None, None, None), (3, None, "user", "x"), (3, 2, "user", "b"), (3, 2, "user", "b"), (3, 2, "bot", "a"), (None, 1, "user", "x"), (7, 99, None, "")]
    rows += [(k, t, "user", f"same{t}") for k in (200, 400, 500, 401, 402, 403, 404, 405) for t in range(30)]
    return rows


@pytest.mark.parametrize(("seed", "block", "chunk"), [(1, 4_096, 65_536), (2, 3, 2), (3, 1, 1)])
def test_trie_equals_a_plain_version(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(seed)
    table = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    assert sorted(map(tuple, prefix_trie.prefix_trie(table).collect()), key=str) == plain_trie(rows)


def test_rounds_follow_branches_not_turns(spark):
    rows = [(c, t, "user", f"{t}") for c in (0, 100, 200) for t in range(120)]
    turns, convs = prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))
    assert turns.count() == 360 and convs.count() == 3
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert len(out) == 121 and {r.n_leaves for r in out} == {1}
    top = next(r for r in out if r.depth == 0)
    assert top.saved_tokens == sum(2 * len(str(t)) for t in range(120))


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
