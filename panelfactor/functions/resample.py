"""Circular block resampling: hashed block starts, and sums over blocks from running totals.

A resample of n rows is ceil(n / b) blocks of b rows from hashed starts, wrapped at the end and cut to n.
Starts depend on (seed, block length, replication, block) alone, so results are the same for every
partitioning. The sums over a block are the difference of two running totals, so a replication
meets two or three rows for each of its blocks instead of all rows that it draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, PANEL
from .scan import running_totals


def block_starts(sizes: DataFrame, block_lengths, replications: int, seed: int) -> DataFrame:
    """panel, n, block_length, replication, start, length of each block; ``sizes``: panel, n."""
    if min(block_lengths) < 2 or replications < 1:
        raise ValueError("blocks need two rows and resampling a replication")
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = sizes.withColumn("block_length", F.explode(F.array(*(F.lit(int(b)) for b in block_lengths)))).withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    dealt = reps.repartition(parts, PANEL, "block_length", "replication").withColumn("_b", F.least(F.col("block_length").cast("long"), F.col("n")))
    blocks = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("_b")) - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("_b"), F.col("replication").cast("long"), F.col("_j")), F.col("n"))
    length = F.least(F.col("_b"), F.col("n") - F.col("_b") * F.col("_j"))
    return blocks.select(PANEL, "n", "block_length", "replication", start.alias("start"), length.alias("length"))


def resampled_sums(rows: DataFrame, pos: str, n: str, values: list[Column], block_lengths, replications: int, seed: int, date: str | None = DATE) -> DataFrame:
    """panel, block_length, replication, n (rows drawn), sums (array over ``values``), first_date and last_date of the rows.

    ``rows``: panel, ``pos`` (0 .. n - 1), ``n`` (rows of the panel) and what ``values`` name; null values count as zero.
    """
    p = len(values)
    sized = rows.select(PANEL, F.col(pos).cast("long").alias("at"), F.col(n).cast("long").alias("n"), *([F.col(date).alias("_d")] if date else []), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(values)))
    made = running_totals(sized, [PANEL], "at", {f"v{k}": F.col(f"v{k}") for k in range(p)})
    # the total before row i is named i, so that before 0 is nothing and needs no row
    totals = made.select(PANEL, (F.col("at") + 1).alias("at"), F.array(*(F.col(f"v{k}") for k in range(p))).alias("total"))
    ends = sized.groupBy(PANEL).agg(F.max("n").alias("n"), *([F.min("_d").alias("first_date"), F.max("_d").alias("last_date")] if date else []))
    blocks = block_starts(ends.select(PANEL, "n"), block_lengths, replications, seed)
    end, size = F.col("start") + F.col("length"), F.col("n")
    mark = lambda at, sign: F.struct(at.alias("at"), F.lit(float(sign)).alias("sign"))
    marks = F.when(end <= size, F.array(mark(end, 1), mark(F.col("start"), -1))).otherwise(F.array(mark(size, 1), mark(F.col("start"), -1), mark(end - size, 1)))
    keys = [PANEL, "block_length", "replication"]
    signed = blocks.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.at", "m.sign").where("at > 0")
    # marks of a replication that fall on one row are one
    signed = signed.groupBy(*keys, "at").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    # every mark meets a row; a left join keeps Spark from broadcasting the marks, whose size it takes from before the explodes
    met = signed.join(totals, [PANEL, "at"], "left")
    sums = met.groupBy(*keys).agg(*(F.sum(F.col("sign") * F.col("total")[k]).alias(f"s{k}") for k in range(p)))
    whole = sums.join(ends, PANEL)
    return whole.select(*keys, "n", *(["first_date", "last_date"] if date else []), F.array(*(F.col(f"s{k}") for k in range(p))).alias("sums"))
