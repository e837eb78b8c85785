"""Sensitivities of a portfolio: a strict two-column CSV and what must be said about it."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PANEL, Nodes
from .panels import file_digest

COLUMNS = ["tenor", "dv01_usd_per_bp"]
METADATA = ("valuation_date", "currency", "curve_id", "bump_bp", "sign_convention", "portfolio_id", "position_snapshot_id", "risk_engine_id")
SIGN = "positive = gain when yields fall"
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}")


def read_dv01(spark: SparkSession, path: str, nodes: Nodes, panel: str = "curve") -> tuple[DataFrame, str]:
    """(panel, node, dv01) of a CSV of at most 1 MB with exactly the columns tenor and dv01_usd_per_bp, and its hash."""
    size, sha = file_digest(spark, path)
    if size > 1_000_000:
        raise ValueError("the file is larger than 1 MB")
    raw = spark.read.option("header", True).csv(path)
    if sorted(raw.columns) != sorted(COLUMNS):
        raise ValueError(f"columns must be exactly {COLUMNS}")
    table = raw.select(F.lit(panel).alias(PANEL), F.trim("tenor").alias("node"), F.expr("try_cast(dv01_usd_per_bp AS DOUBLE)").alias("dv01"))
    rows = table.limit(len(nodes.names) + 1).collect()
    if sorted(r.node or "" for r in rows) != sorted(nodes.names) or any(r.dv01 is None or abs(r.dv01) == float("inf") or r.dv01 != r.dv01 for r in rows):
        raise ValueError("each node needs exactly one finite sensitivity")
    return table, sha


def read_instruments(spark: SparkSession, path: str, nodes: Nodes, panel: str = "curve") -> DataFrame:
    """(panel, instrument, node, dv01) of a CSV of at most 1 MB with exactly instrument, tenor and dv01_usd_per_bp; nodes that an instrument leaves out are zero."""
    if file_digest(spark, path)[0] > 1_000_000:
        raise ValueError("the file is larger than 1 MB")
    raw = spark.read.option("header", True).csv(path)
    if sorted(raw.columns) != sorted(["instrument", *COLUMNS]):
        raise ValueError(f"columns must be exactly {['instrument', *COLUMNS]}")
    told = raw.select(F.trim("instrument").alias("instrument"), F.trim("tenor").alias("node"), F.expr("try_cast(dv01_usd_per_bp AS DOUBLE)").alias("dv01"))
    wrong = told.groupBy("instrument", "node").agg(F.count("*").alias("n"), F.count_if(F.col("dv01").isNull() | F.isnan("dv01") | (F.abs("dv01") == float("inf"))).alias("bad"))
    if wrong.where((F.col("n") > 1) | (F.col("bad") > 0) | ~F.col("node").isin(*nodes.names) | F.col("instrument").isNull()).limit(1).count():
        raise ValueError("each instrument needs finite sensitivities to known nodes, one for each")
    every = told.select("instrument").distinct().withColumn("node", F.explode(F.array(*(F.lit(n) for n in nodes.names))))
    return every.join(told, ["instrument", "node"], "left").select(F.lit(panel).alias(PANEL), "instrument", "node", F.coalesce("dv01", F.lit(0.0)).alias("dv01"))


def check_metadata(metadata: dict | None, has_positions: bool, curve_id: str, today: date) -> None:
    """Metadata must come with positions, and only then, and say what the positions are."""
    if has_positions != (metadata is not None):
        raise ValueError("positions and their metadata belong together")
    if metadata is None:
        return
    if sorted(metadata) != sorted(METADATA):
        raise ValueError(f"metadata must have exactly {METADATA}")
    for name in ("portfolio_id", "position_snapshot_id", "risk_engine_id", "curve_id"):
        if not isinstance(metadata[name], str) or not _ID.fullmatch(metadata[name]):
            raise ValueError(f"{name} is no identifier")
    if date.fromisoformat(metadata["valuation_date"]) > today:
        raise ValueError("valuation_date lies in the future")
    if metadata["currency"] != "USD" or float(metadata["bump_bp"]) != 1.0 or metadata["sign_convention"] != SIGN:
        raise ValueError("currency, bump or sign convention differ from what the analysis assumes")
    if metadata["curve_id"] != curve_id:
        raise ValueError("the positions belong to another curve")
