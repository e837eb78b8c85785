"""Curves from a stream of observations: the last complete day of each week, kept up to date.

Node values of a day are averaged under a watermark; a finished day that has every node is emitted once.
Downstream, :func:`refresh` folds each micro-batch into a table of weekly curves by reading what is
there for the touched periods only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.panel import complete, period_end
from ..schema import DATE, PANEL, PERIOD_END, col


def stream_daily(observations: DataFrame, nodes, late: str = "2 days") -> DataFrame:
    """Complete days of a stream (panel, ts, node, value): panel, date and a column for each node.

    Append mode: a day comes out once the watermark has passed its end; rows later than ``late`` are dropped.
    """
    day = F.window("ts", "1 day")
    means = [F.avg(F.when(F.col("node") == n, F.col("value"))).alias(n) for n in nodes]
    daily = observations.withWatermark("ts", late).groupBy(PANEL, day).agg(*means)
    return complete(daily.select(PANEL, F.to_date("window.start").alias(DATE), *(col(n) for n in nodes)), nodes)


def refresh(target: str, nodes, anchor: str = "FRI"):
    """A foreachBatch function that keeps ``target`` (Parquet, partitioned by period) at the last complete day of each period.

    Only partitions of periods in the batch are read and replaced; a replayed batch changes nothing.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        columns = [PANEL, DATE, *nodes]
        fresh = batch.select(*(col(c) for c in columns)).withColumn(PERIOD_END, period_end(F.col(DATE), anchor))
        periods = [r[0] for r in fresh.select(PERIOD_END).distinct().collect()]
        if not periods:
            return
        try:
            held = spark.read.parquet(target).where(F.col(PERIOD_END).isin(periods)).select(*(col(c) for c in columns), F.col(PERIOD_END).cast("date").alias(PERIOD_END))
            fresh = fresh.unionByName(held)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        row = F.max_by(F.struct(*(col(c) for c in columns)), F.struct(F.col(DATE)))
        last = fresh.groupBy(PANEL, PERIOD_END).agg(row.alias("x")).select(*(F.col(f"x.`{c}`").alias(c) for c in columns), PERIOD_END)
        last.repartition(PERIOD_END).write.mode("overwrite").partitionBy(PERIOD_END).parquet(target)

    return fold
