"""Stability of a factor model: rolling and adjacent windows, block bootstrap, out-of-sample reconstruction.

Every sample is a group of the same sums: a row is spread to the windows it lies in by arithmetic on
its position (no range join), sums combine before the shuffle, and one small kernel row is left for
each window, vintage or replication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resample import resampled_sums
from ..functions.scan import expanding_moments
from ..schema import DATE, PANEL, POS, Nodes, vector
from . import factors
from .moments import deviations, from_sums, moments, products
from .panel import changes as period_changes
from .panel import complete, weekly_curve

END = "window_end"


def _column(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _windows(changes: DataFrame, width: Column, step: int) -> DataFrame:
    """Rows with the ends (counts of rows) of all windows of ``width`` rows that hold them: width, width + step, ..., and the last row."""
    n, pos = F.col("n_rows"), F.col(POS)
    first = F.greatest(F.lit(0), F.floor((pos - width) / step) + 1)
    last = F.least(F.floor((n - width) / step), F.floor(pos / step))
    regular = F.when(first <= last, F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda j: j * step + width)).otherwise(F.array().cast("array<long>"))
    tail = F.when(((n - width) % step != 0) & (pos >= n - width), F.array(n)).otherwise(F.array().cast("array<long>"))
    return changes.where(n >= width).withColumn(END, F.explode(F.concat(regular, tail)))


def rolling(changes: DataFrame, reference: DataFrame, nodes: Nodes, window: int | Column, step: int = 13, k: int = 3, standardize: bool = False, **thresholds) -> DataFrame:
    """Each window's model held against the panel's reference model: shares, angles, distances, cosines.

    ``window``: rows, or a column of ``changes`` where panels differ. The reference must have the windows' own
    specification: unweighted, and standardised or not as they are.
    """
    if isinstance(window, int) and window < 52:
        raise ValueError("a window needs 52 rows")
    refuse_other_reference(reference, standardize)
    sums = moments(_windows(changes, _column(window), step), nodes.names, keys=(PANEL, END))
    candidates = factors.models(sums, nodes.maturities, standardize, keys=(PANEL, END), **thresholds)
    return _against(candidates, reference, k, (PANEL, END))


def refuse_other_reference(reference: DataFrame, standardize: bool) -> None:
    """Raise if a reference model is weighted (its effective rows are fewer than its rows) or standardised other than ``standardize``."""
    unit = F.forall("scale", lambda s: s == 1)
    wrong = reference.where("center IS NOT NULL").where((F.col("n_eff") < F.col("n_obs") - 1e-6) | (F.lit(standardize) == unit)).limit(3).collect()
    if wrong:
        raise ValueError("samples are unweighted and " + ("standardised" if standardize else "in node units") + ", and so must their reference be: " + ", ".join(str(r[PANEL]) for r in wrong))


def _against(candidates: DataFrame, reference: DataFrame, k: int, keys) -> DataFrame:
    both = factors.prefixed(candidates, "c_", keys).join(factors.prefixed(reference, "r_"), PANEL).where("c_center is not null and r_center is not null")

    def kernel(batch):
        side = lambda p: {c: batch[p + c] for c in ("physical", "eigenvalues", "share", "similarity")}
        return factors.compare_many(side("r_"), side("c_"), k)

    keep = [*keys, "c_n_obs", "c_first_date", "c_last_date", "r_first_date", "r_last_date", "r_identified", "r_suggested"]
    out = factors.per_batch(both, kernel, keep, factors.COMPARISON)
    named = {"c_n_obs": "n_obs", "c_first_date": "first_date", "c_last_date": "last_date", "r_first_date": "reference_first_date", "r_last_date": "reference_last_date", "r_identified": "reference_identified", "r_suggested": "reference_suggested"}
    return out.withColumnsRenamed(named)


def sequential(changes: DataFrame, nodes: Nodes, window: int | Column, step: int = 13, k: int = 3, standardize: bool = False, **thresholds) -> DataFrame:
    """Each window's model held against that of the window of equal length just before it; panels shorter than both have no rows."""
    if isinstance(window, int) and window < 52:
        raise ValueError("a window needs 52 rows")
    spread = _windows(changes, 2 * _column(window), step).withColumn("late", F.col(POS) >= F.col(END) - window)
    keys = (PANEL, END, "late")
    made = factors.models(moments(spread, nodes.names, keys=keys), nodes.maturities, standardize, keys=keys, **thresholds)
    early, late = made.where("not late").drop("late"), made.where("late").drop("late")
    out = factors.compare_models(early, late, k, keys=(PANEL, END))
    return out.withColumn("min_cosine", F.array_min("cosines"))


def bootstrap(changes: DataFrame, reference: DataFrame, nodes: Nodes, replications: int = 2000, block_lengths=(13,), k: int = 3, seed: int = 20260825, standardize: bool = False, **thresholds) -> DataFrame:
    """One comparison row for each (panel, block_length, replication)."""
    refuse_other_reference(reference, standardize)
    keys = (PANEL, "block_length", "replication")
    about = deviations(changes, nodes.names)
    drawn = resampled_sums(about, POS, "n_rows", products(nodes.names), block_lengths, replications, seed)
    drawn = drawn.join(about.groupBy(PANEL).agg(F.first("_centre").alias("_centre")), PANEL)
    made = factors.models(from_sums(drawn, len(nodes.names), keys), nodes.maturities, standardize, keys=keys, **thresholds)
    return _against(made, reference, k, keys)


def bootstrap_summary(replicas: DataFrame, k: int, seed: int) -> DataFrame:
    """2.5 %, 50 % and 97.5 % points of each metric, by block length."""
    metrics = [F.struct(F.lit("top_share").alias("metric"), F.col("top_share").alias("v")), F.struct(F.lit("max_angle").alias("metric"), F.col("max_angle").alias("v"))]
    metrics += [F.struct(F.lit(f"cosine_{j + 1}").alias("metric"), F.col("cosines")[j].alias("v")) for j in range(k)]
    long = replicas.select(PANEL, "block_length", F.explode(F.array(*metrics)).alias("x")).select(PANEL, "block_length", "x.*")
    q = long.groupBy(PANEL, "block_length", "metric").agg(F.count("*").alias("replications"), F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(PANEL, "block_length", "metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "replications", F.lit(seed).alias("seed"), (F.col("replications") * 0.025).alias("tail_order_statistics"))


def block_sensitivity(summary: DataFrame) -> DataFrame:
    """How the bootstrap's main figures move with the block length."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    least = F.min(F.when(F.col("metric").startswith("cosine"), F.col("median")))
    return summary.groupBy(PANEL, "block_length").agg(F.max("replications").alias("replications"), pick("max_angle", "median").alias("angle_median"), pick("max_angle", "high").alias("angle_high"), pick("top_share", "median").alias("share_median"), pick("top_share", "low").alias("share_low"), least.alias("min_cosine_median"))


def vintages(changes: DataFrame, nodes: Nodes, train: int | Column, every: int, standardize: bool = False) -> DataFrame:
    """Models of all rows before position train, train + every, ...: panel, vintage, model.

    ``train``: a number, or a column of ``changes`` where panels differ.
    """
    p = len(nodes.names)
    begin = train if isinstance(train, Column) else F.lit(train)
    seen = expanding_moments(changes.withColumn("_train", begin), nodes.names, first_dates=True).where((F.col(POS) >= F.col("_train")) & ((F.col(POS) - F.col("_train")) % every == 0))
    last = changes.select(PANEL, (F.col(POS) + 1).alias(POS), F.col(DATE).alias("last_date"))
    rows = seen.join(last, [PANEL, POS]).select(
        PANEL, ((F.col(POS) - F.col("_train")) / every).cast("long").alias("vintage"), F.col("n_before").cast("long").alias("n_obs"), F.col("n_before").alias("n_eff"), "first_date", "last_date", "mean",
        F.transform("m2", lambda v: v / (F.col("n_before") - 1)).alias("cov"),
    )
    return factors.models(rows, nodes.maturities, standardize, keys=(PANEL, "vintage"))


def oos_reconstruction(changes: DataFrame, nodes: Nodes, train: int | Column, every: int = 13, k: int = 3, standardize: bool = False) -> DataFrame:
    """Rows from position ``train`` on, rebuilt from k scores of the newest earlier vintage: panel, date, pos, node, actual, fitted, vintage, training span.

    The observed row is projected (a reconstruction, not a forecast); its model has seen earlier rows only.
    """
    if isinstance(train, int) and train < 52:
        raise ValueError("training needs 52 rows")
    names, begin = nodes.names, train if isinstance(train, Column) else F.lit(train)
    made = vintages(changes, nodes, train, every, standardize).withColumnsRenamed({"first_date": "training_start", "last_date": "training_end", "n_obs": "training_rows"})
    later = changes.where(F.col(POS) >= begin).withColumn("vintage", F.floor((F.col(POS) - begin) / every).cast("long"))
    rows = later.join(made, [PANEL, "vintage"]).withColumn("scores", factors.score_array(vector(names))).withColumn("fitted", factors.inverse_array(F.col("scores"), k, len(names)))
    cells = F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("node"), vector(names).alias("actual"), F.col("fitted"))
    keep = [PANEL, DATE, POS, "vintage", "training_start", "training_end", "training_rows"]
    return rows.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.node", "x.actual", "x.fitted")


def regimes(changes: DataFrame, nodes: Nodes, cutoff: str, k: int = 3, least_rows: int = 104, **thresholds) -> DataFrame:
    """Model before ``cutoff`` against that after it; the change that spans the cutoff is in neither.

    Panels whose sides are too short have status NOT EVALUATED and no figures.
    """
    cut = F.lit(cutoff).cast("date")
    first_after = F.min(F.when(F.col(DATE) >= cut, F.col(DATE))).over(Window.partitionBy(PANEL))
    sided = changes.withColumn("side", F.when(F.col(DATE) < cut, 0).when(F.col(DATE) > first_after, 1)).where("side is not null")
    keys = (PANEL, "side")
    sums = moments(sided, nodes.names, keys=keys)
    counts = changes.select(PANEL).distinct().join(sums.groupBy(PANEL).agg(F.max(F.when(F.col("side") == 0, F.col("n_obs"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("n_obs"))).alias("after")), PANEL, "left")
    ok = (F.coalesce("before", F.lit(0)) >= least_rows) & (F.coalesce("after", F.lit(0)) >= least_rows)
    made = factors.models(sums.where(F.col("n_obs") >= least_rows), nodes.maturities, keys=keys, **thresholds)
    table = factors.regime_table(factors.compare_models(made.where("side = 0").drop("side"), made.where("side = 1").drop("side"), k))
    status = F.when(ok, "EVALUATED").otherwise("NOT EVALUATED").alias("status")
    return counts.select(PANEL, F.coalesce("before", F.lit(0)).alias("n_before"), F.coalesce("after", F.lit(0)).alias("n_after"), status).join(table, PANEL, "left")


def specifications(changes: DataFrame, nodes: Nodes, halflife: float = 52, k: int = 3, **thresholds) -> DataFrame:
    """Covariance, correlation and recency-weighted models of each panel side by side."""
    made = [("covariance", factors.fit(changes, nodes, **thresholds)), ("correlation", factors.fit(changes, nodes, standardize=True, **thresholds)), ("recency", factors.fit(changes, nodes, halflife=halflife, **thresholds))]
    rows = [m.select(PANEL, F.lit(name).alias("specification"), "first_date", "last_date", "n_obs", "n_eff", *(F.col("share")[j].alias(f"share_{j + 1}") for j in range(3)), F.aggregate(F.slice("share", 1, k), F.lit(0.0), lambda s, x: s + x).alias("top_share"), F.array_min("similarity").alias("min_similarity"), F.array_min("margin").alias("min_margin")) for name, m in made]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def extended_specifications(daily: DataFrame, core: Nodes, universe: Nodes, anchor: str, policy: str, start: str, end: str, k: int = 3, least_days: int = 60, least_changes: int = 52, **thresholds) -> DataFrame:
    """Models of the core nodes and of all nodes over the weeks in which all are there: panel, curve, span, shares, similarity, margin.

    Panels in which all nodes are there on under ``least_days`` days, or for under ``least_changes`` changes, have no rows.
    """
    weekly = weekly_curve(daily, universe.names, anchor, policy, start, end)
    days = complete(daily, universe.names).groupBy(PANEL).agg(F.countDistinct(DATE).alias("n")).where(F.col("n") >= least_days)
    moved = period_changes(weekly, universe.names).where(F.col("n_rows") >= least_changes).join(days.select(PANEL), PANEL, "left_semi")
    rows = [factors.fit(moved, nodes, **thresholds).select(PANEL, F.lit(name).alias("curve"), "first_date", "last_date", "n_obs", *(F.col("share")[j].alias(f"share_{j + 1}") for j in range(3)), F.aggregate(F.slice("share", 1, k), F.lit(0.0), lambda s, x: s + x).alias("top_share"), F.array_min("similarity").alias("min_similarity"), F.array_min("margin").alias("min_margin")) for name, nodes in (("core", core), ("extended", universe))]
    return rows[0].unionByName(rows[1])
