"""Which rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def learnable(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """doc_id and y (0 or 1) of the labels that may be learnt from.

    Null ids, labels other than 0 and 1 and held-out rows are left out; an id labelled both ways is, too.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
    return good.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select(F.col("doc_id").alias("l_doc_id"), "y")
