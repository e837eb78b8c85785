"""Tables that several plans start from, written once to the folder that the cluster shares and read back.

This cuts the lineage (plans stay short, however many steps follow) and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in a session with a local master, and an error in any other."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master!r})")
    return f"file://{tempfile.gettempdir()}"


class Shelf:
    """Written tables of one analysis, deleted together by :meth:`clear`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.used = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}", False

    def put(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        table.write.parquet(path)
        self.used = True
        return self.spark.read.schema(table.schema).parquet(path)

    def clear(self) -> None:
        if self.used:
            forget(self.spark, self.folder)
            self.used = False
