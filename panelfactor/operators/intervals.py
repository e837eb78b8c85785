"""Prediction bands from past residuals, and the evidence that they cover what they claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resample import resampled_sums
from ..functions.sliding import sliding_quantiles
from ..functions.stats import binomial_at_most, wilson
from ..schema import DATE, PANEL, POS

COVERAGES = (0.80, 0.95)
ROW = "row"
#: Block bounds with fewer order statistics in a tail rest on single draws and decide nothing.
LEAST_ORDER_STATISTICS = 20


def residuals(predictions: DataFrame) -> DataFrame:
    """actual - fitted of one model's predictions, with the 0-based row of each residual in its (panel, node)."""
    order = Window.partitionBy(PANEL, "node").orderBy(POS)
    return predictions.select(PANEL, DATE, POS, "node", (F.col("actual") - F.col("fitted")).alias("residual")).withColumn(ROW, F.row_number().over(order) - 1)


def selected_residuals(predictions: DataFrame, gate: DataFrame) -> DataFrame:
    """Residuals of the model that the gate selected in each panel."""
    return residuals(predictions.join(gate.where("selected").select(PANEL, "model"), [PANEL, "model"], "left_semi"))


def hits(rows: DataFrame, history: int = 260, least: int = 104, evaluate_from: int | None = None, coverages=COVERAGES, evaluate_last: int | None = None) -> DataFrame:
    """panel, date, pos, row, node, coverage, lower, upper, hit: whether each residual lies in the band of those before it.

    A band is a pair of exact quantiles (linear) of up to ``history`` earlier residuals, never the current one. Rows
    before the larger of ``least`` and ``evaluate_from`` are not evaluated, nor are those before a panel's ``evaluate_last`` last ones.
    """
    points = sorted({q for c in coverages for q in ((1 - c) / 2, 1 - (1 - c) / 2)})
    needed = rows.select(PANEL, DATE, POS, ROW, "node", "residual")
    banded = sliding_quantiles(needed, [PANEL, "node"], ROW, "residual", history, points).where(F.col(ROW) >= max(least, evaluate_from or 0))
    if evaluate_last is not None:
        sizes = rows.groupBy(PANEL, "node").agg(F.count("*").alias("_n"))
        banded = banded.join(sizes, [PANEL, "node"]).where(F.col(ROW) >= F.col("_n") - evaluate_last).drop("_n")
    bands = F.array(*(F.struct(F.lit(float(c)).alias("coverage"), F.col("q")[points.index((1 - c) / 2)].alias("lower"), F.col("q")[points.index(1 - (1 - c) / 2)].alias("upper")) for c in coverages))
    long = banded.select(PANEL, DATE, POS, ROW, "node", "residual", F.explode(bands).alias("b")).select(PANEL, DATE, POS, ROW, "node", "residual", "b.*")
    return long.withColumn("hit", F.col("residual").between(F.col("lower"), F.col("upper")))


def block_bounds(hit_rows: DataFrame, node_names, alpha: float, block_lengths=(4, 13, 26), replications: int = 20_000, seed: int = 17_729, coverages=COVERAGES) -> DataFrame:
    """panel, coverage, node, low, high: the widest of the block lengths' intervals for the hit rate.

    Rows are resampled in circular blocks, jointly over nodes; the tails are alpha / (2 x coverages x nodes).
    """
    cells = [(float(c), n) for c in coverages for n in node_names]
    tail = alpha / (2 * len(cells))
    whole = Window.partitionBy(PANEL)  # rows: one for each evaluated forecast
    hit = F.col("hit").cast("int")
    # one row holds the hits of all nodes and coverages, so they share its draws
    wide = hit_rows.groupBy(PANEL, ROW).agg(*(F.max(F.when((F.col("coverage") == c) & (F.col("node") == n), hit)).alias(f"h{k}") for k, (c, n) in enumerate(cells)))
    placed = wide.withColumn("at", (F.col(ROW) - F.min(ROW).over(whole)).cast("long")).withColumn("n", F.count("*").over(whole)).drop(ROW)
    # a hit that is null (a node that a row lacks) counts neither as one nor as a draw
    values = [F.col(f"h{k}") for k in range(len(cells))] + [F.col(f"h{k}").isNotNull().cast("int") for k in range(len(cells))]
    drawn = resampled_sums(placed, "at", "n", values, block_lengths, replications, seed, date=None)
    rates = drawn.select(PANEL, "block_length", "replication", *(F.when(F.col("sums")[k + len(cells)] > 0, F.col("sums")[k] / F.col("sums")[k + len(cells)]).alias(f"h{k}") for k in range(len(cells))))
    ends = F.array(F.lit(tail), F.lit(1 - tail))
    q = rates.groupBy(PANEL, "block_length").agg(*(F.percentile(f"h{k}", ends).alias(f"h{k}") for k in range(len(cells))))
    widest = q.groupBy(PANEL).agg(F.array(*(F.struct(F.lit(c).alias("coverage"), F.lit(n).alias("node"), F.min(F.col(f"h{k}")[0]).alias("low"), F.max(F.col(f"h{k}")[1]).alias("high")) for k, (c, n) in enumerate(cells))).alias("x"))
    return widest.select(PANEL, F.explode("x").alias("x")).select(PANEL, "x.*").where("low is not null")


def coverage_counts(hit_rows: DataFrame, tolerance: float = 0.03, alpha: float = 0.05) -> DataFrame:
    """Hits, rate, floor, Wilson bounds, gap and lag-1 correlation for each (panel, coverage, node)."""
    keys = [PANEL, "coverage", "node"]
    rows = hit_rows.select(*keys, F.col("hit").cast("double").alias("h"), F.lag(F.col("hit").cast("double")).over(Window.partitionBy(*keys).orderBy(POS)).alias("before"))
    known = F.col("before").isNotNull()
    moving = (F.var_pop("before") > 0) & (F.var_pop(F.when(known, F.col("h"))) > 0)
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("h").cast("long").alias("hits"), F.avg("h").alias("rate"), F.when(moving, F.covar_pop(F.when(known, F.col("h")), F.col("before")) / F.sqrt(F.var_pop("before") * F.var_pop(F.when(known, F.col("h"))))).alias("lag_1"))
    low, high = wilson(F.col("rate"), F.col("n"), alpha)
    return g.select(*keys, "n", "hits", "rate", (F.col("coverage") - tolerance).alias("floor"), low.alias("wilson_low"), high.alias("wilson_high"), "lag_1", (F.col("rate") - F.col("coverage")).alias("gap"))


def coverage(rows: DataFrame, nodes, history: int = 260, least: int = 104, evaluate_from: int | None = None, tolerance: float = 0.03, alpha: float = 0.05, block_lengths=(4, 13, 26), replications: int = 20_000, seed: int = 17_729, coverages=COVERAGES, evaluate_last: int | None = None) -> DataFrame:
    """Coverage evidence of each (panel, coverage, node), with status.

    WARN if even the upper block bound misses the floor, PASS if the lower one reaches it, else INCONCLUSIVE; without
    evaluated rows NOT EVALUATED. Bounds with under LEAST_ORDER_STATISTICS in a tail are INCONCLUSIVE.
    """
    keys = [PANEL, "coverage", "node"]
    hit_rows = hits(rows, history, least, evaluate_from, coverages, evaluate_last)
    counts = coverage_counts(hit_rows, tolerance, alpha)
    bounds = block_bounds(hit_rows, nodes.names, alpha, block_lengths, replications, seed, coverages)
    wanted = rows.select(PANEL, "node").distinct().withColumn("coverage", F.explode(F.array(*(F.lit(float(c)) for c in coverages))))
    out = wanted.join(counts, keys, "left").join(bounds, keys, "left").withColumn("binomial_p", binomial_at_most("hits", "n", "floor"))
    in_tail = replications * alpha / (2 * len(coverages) * len(nodes.names))
    status = F.when(F.col("n").isNull(), "NOT EVALUATED").when(F.lit(in_tail < LEAST_ORDER_STATISTICS), "INCONCLUSIVE").when(F.col("high") < F.col("floor"), "WARN").when(F.col("low") >= F.col("floor"), "PASS").otherwise("INCONCLUSIVE")
    out = out.withColumn("status", status).withColumn("tail_order_statistics", F.lit(in_tail))
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def joint_hits(hit_rows: DataFrame) -> DataFrame:
    """Share of rows where every node lies in its own band (a diagnostic: bands are not joint)."""
    by_row = hit_rows.groupBy(PANEL, "coverage", POS).agg(F.min(F.col("hit").cast("int")).alias("all_in"))
    return by_row.groupBy(PANEL, "coverage").agg(F.count("*").alias("n"), F.avg("all_in").alias("joint_rate"))


def latest_bands(rows: DataFrame, forecast: DataFrame, history: int = 260, coverages=COVERAGES) -> DataFrame:
    """Bands around the next level from the last ``history`` residuals: panel, node, coverage, lower, upper."""
    n = Window.partitionBy(PANEL, "node")
    recent = rows.withColumn("n", F.count("*").over(n)).where(F.col(ROW) >= F.col("n") - history)
    points = [q for c in coverages for q in ((1 - c) / 2, 1 - (1 - c) / 2)]
    q = recent.groupBy(PANEL, "node").agg(F.percentile("residual", F.array(*(F.lit(float(x)) for x in points))).alias("q"))
    bands = F.array(*(F.struct(F.lit(float(c)).alias("coverage"), F.col("q")[2 * i].alias("a"), F.col("q")[2 * i + 1].alias("b")) for i, c in enumerate(coverages)))
    out = forecast.join(q, [PANEL, "node"]).select(PANEL, "node", "target_period_end", "level", "change", "forecast_level", F.explode(bands).alias("x"))
    at = lambda c: F.col("level") + (F.col("change") + F.col(c)) / 100
    return out.select(PANEL, "node", "target_period_end", "forecast_level", "x.coverage", at("x.a").alias("lower"), at("x.b").alias("upper"))
