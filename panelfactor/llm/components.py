"""Connected components of an edge table, as Spark joins (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .skew import split_join


def _smallest(directed: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the smallest of u and its neighbours; a node's neighbours are never gathered in one row or task."""
    least = directed.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"), F.count("*").alias("degree")).withColumn("m", F.least("low", "node"))
    least = store.written(least, "smallest")
    total = least.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    return split_join(directed, least, {"u": "node"}, "degree", total).select("u", "v", "m")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node that it reaches.

    Self-loops and repeated edges change nothing; rows with a null end are ignored; no edges, no rows.
    Each round is written to the shared folder; rounds end when the edges are stars.
    """
    now = store.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.unionByName(store.again(now).select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.written(large.where("u <> v"), name)
        small = _smallest(store.again(large))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        last, now = now, store.written(small, name)
        store.drop(large)
        store.drop(last)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(store.again(now).select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
