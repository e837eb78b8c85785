"""Intermediate tables in the folder that the cluster shares.

Operators that read one computed table several times write it as Parquet below
``spark.checkpoint.dir`` and read it back: this cuts the lineage and survives lost executors.
A :func:`scope` owns the tables written inside it and deletes them when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests, one machine) gets a temporary folder that ends with the
    process; any other session gets an error, since its executors would each write to their own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master!r})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; the innermost scope owns it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (one job, no lineage)."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` written once, hashed into ``buckets`` by ``column``: grouping and joining by it needs no shuffle of this table.

    Spark keeps a table's buckets in the catalog only; the entry goes as soon as the files are known.
    """
    spark = df.sparkSession
    path, table = folder(spark, name), f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the entry goes
    out._stored_at = path
    spark.sql(f"DROP TABLE {table}")
    return out


def again(df: DataFrame) -> DataFrame:
    """A table made by :func:`written`, read once more (for joins with itself)."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._stored_at)
    out._stored_at = df._stored_at
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later step reads."""
    if getattr(df, "_stored_at", None):
        delete(df.sparkSession, df._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of the shared folder."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        shutil.rmtree(where.path, ignore_errors=True)
    else:  # a store that only Spark reaches: its writer replaces the files by none
        spark.range(0).write.mode("overwrite").parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at the end: read or write every lazy result of the operators before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            delete(spark, path)
