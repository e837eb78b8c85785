"""Checks of a panel and of an analysis, and what they add up to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DATE, FAIL, GAP, NEEDS_REVISION, PANEL, PASS, POS, READY, WARN, WITH_CAVEATS, Nodes, col, vector
from . import factors
from .panel import complete, period_end
from .tsqr import spectrum


def quality_metrics(daily: DataFrame, weekly: DataFrame, changes: DataFrame, nodes: Nodes, core, anchor: str = "FRI", policy: str = "drop", start: str | None = None, end: str | None = None) -> DataFrame:
    """All figures that the checks need, one row for each panel: one aggregation over each of the three tables."""
    names = list(nodes.names)
    values = F.array(*(col(n) for n in names))
    days = daily.groupBy(PANEL).agg(
        F.count("*").alias("n_days"), (F.count(DATE) - F.countDistinct(DATE)).alias("duplicate_days"),
        F.min(F.array_min(values)).alias("min_value"), F.max(F.array_max(values)).alias("max_value"),
        F.sum(F.size(F.filter(values, lambda v: v == 0))).alias("n_zeros"), F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"),
    )
    whole = complete(daily, core).groupBy(PANEL).agg(F.min(DATE).alias("first_complete"), F.max(DATE).alias("last_complete"))
    weeks = weekly.groupBy(PANEL).agg(F.count("*").alias("n_weeks"), F.min(DATE).alias("first_week"), F.max(DATE).alias("last_week"), sum(F.count_if(col(n).isNull()) for n in core).alias("week_nulls"))
    moved = changes.groupBy(PANEL).agg(
        F.count("*").alias("n_changes"), F.max(GAP).alias("max_gap"), F.min(GAP).alias("min_gap"), F.count_if(F.col(GAP) != 7).alias("not_seven"), sum(F.count_if(col(n).isNull()) for n in core).alias("change_nulls"),
        F.max(F.array_max(F.array(*(F.abs(col(n)) for n in core)))).alias("max_jump"), F.array_compact(F.array(*(F.when(F.coalesce(F.var_samp(col(n)), F.lit(0.0)) <= factors.TINY, F.lit(n)) for n in core))).alias("constant_nodes"),
        F.collect_set(GAP).alias("gaps"),
    )
    m = days.join(whole, PANEL, "left").join(weeks, PANEL, "left").join(moved, PANEL, "left")
    first, last = period_end(F.col("first_week"), anchor), period_end(F.col("last_week"), anchor)
    lo, hi = F.coalesce(F.lit(start).cast("date"), F.col("first_day")), F.coalesce(F.lit(end).cast("date"), F.col("last_day"))
    want_first, want_last = period_end(F.col("first_complete"), anchor), period_end(F.col("last_complete"), anchor)
    if policy == "drop":  # a boundary period that the request cuts is expected to be left out
        want_first = F.when(lo > F.date_sub(want_first, 6), F.date_add(want_first, 7)).otherwise(want_first)
        want_last = F.when(hi < want_last, F.date_sub(want_last, 7)).otherwise(want_last)
    return m.select(
        "*", F.datediff("first_complete", lo).alias("start_lag"), F.datediff(hi, "last_week").alias("end_lag"), F.datediff(F.least(hi, last), "last_week").alias("within_week_lag"),
        ((first == want_first) & (last == want_last)).alias("boundary_periods"), ((lo > F.date_sub(first, 6)) | (hi < last)).alias("partial_boundary"),
    )


def _between(low, high):
    return (lambda c: c.between(low, high)), f"{low} to {high}"


def _at_most(limit):
    return (lambda c: c <= limit), f"at most {limit}"


def _at_least(limit):
    return (lambda c: c >= limit), f"at least {limit}"


def quality_checks(metrics: DataFrame, settings, mode: str = "SNAPSHOT", as_of: str | None = None, regime_change: str | None = None) -> DataFrame:
    """panel, measured_on, control, figure, allowed, status: one row for each panel and control.

    A control compares one figure of ``metrics`` (a column, as a number) with what ``settings`` (a DataConfig) allow;
    ``measured_on`` is the table that the figure comes from. A figure that is null or out of range gets the
    control's own status. ``as_of`` is the injected clock. Controls that no figure can settle (a history without
    vintages, a stand-in source) always warn.
    """
    s, c = settings, F.col
    truth = lambda x: x.cast("int")
    none, one = _between(0, 0), _at_least(1)
    by_table = {
        "daily": [
            ("Day held twice", c("duplicate_days"), none, FAIL),
            ("Smallest value", c("min_value"), ((lambda x: x > -5), "above -5"), FAIL),
            ("Largest value", c("max_value"), ((lambda x: (x >= 0.25) & (x < 25)), "0.25 to below 25"), FAIL),
            ("Values of zero", c("n_zeros"), none, WARN),
            ("Days before the first whole one", c("start_lag"), _between(0, s.maximum_start_coverage_gap_days), FAIL),
        ],
        "weekly": [
            ("Empty cells in weeks", c("week_nulls"), none, FAIL),
            ("Days after the last week", c("end_lag"), _between(0, s.maximum_end_coverage_gap_days), FAIL),
            ("Days from the last curve to its week's end", c("within_week_lag"), _between(0, s.maximum_within_week_observation_lag_days), FAIL),
            ("First and last week are those expected", truth(c("boundary_periods")), one, FAIL),
            ("Weeks cut by the request", truth(c("partial_boundary")), none, WARN),
        ],
        "changes": [
            ("Changes", c("n_changes"), _at_least(s.minimum_complete_weeks), FAIL),
            ("Empty cells in changes", c("change_nulls"), none, FAIL),
            ("Nodes that never move", F.size("constant_nodes"), none, FAIL),
            ("Longest gap in days", c("max_gap"), _at_most(s.maximum_calendar_gap_days), FAIL),
            ("Changes over other than seven days", c("not_seven"), none, WARN),
            ("Largest move in hundredths", c("max_jump"), _at_most(250), WARN),
        ],
    }
    age = F.datediff(F.lit(as_of).cast("date"), "last_week")
    limit = s.maximum_staleness_days
    asked = [("Age in days", age, _at_most(limit), FAIL) if limit is not None else ("Age in days", age, ((lambda x: F.lit(False)), "no limit is set"), WARN)]
    if regime_change:
        day = F.lit(regime_change).cast("date")
        asked.append((f"History on both sides of {regime_change}", truth((c("first_day") < day) & (c("last_day") >= day)), none, WARN))
    told = [("Vintages kept", F.lit(0), one, WARN)]
    told += [("Live source reached", F.lit(0), one, WARN)] if mode == "SNAPSHOT_FALLBACK" else []
    told += [("Payload kept", F.lit(0), one, WARN)] if mode == "LIVE_FRED_NO_CACHE" else []
    rows = [(table, *row) for table, controls in (*by_table.items(), ("request", asked), ("source", told)) for row in controls]
    checks = F.array(
        *(
            F.struct(F.lit(table).alias("measured_on"), F.lit(name).alias("control"), figure.cast("double").alias("figure"), F.lit(allowed).alias("allowed"), F.when(F.coalesce(holds(figure), F.lit(False)), PASS).otherwise(bad).alias("status"))
            for table, name, figure, (holds, allowed), bad in rows
        )
    )
    return metrics.select(PANEL, F.explode(checks).alias("x")).select(PANEL, "x.*")


def history_checks(sizes: DataFrame, least_changes: int, halflife: float, least_effective: float) -> DataFrame:
    """FAIL rows (as :func:`quality_checks` makes) of panels (panel, n) too short for a rolling window or for recency weights."""
    r = 0.5 ** (1 / halflife)
    n = F.col("n")
    one, two = (1 - F.pow(F.lit(r), n)) / (1 - r), (1 - F.pow(F.lit(r * r), n)) / (1 - r * r)
    effective = one * one / two
    cells = [("Changes for a rolling window", n.cast("double"), least_changes), ("Effective changes under recency weights", effective, least_effective)]
    rows = F.array(*(F.struct(F.lit("changes").alias("measured_on"), F.lit(c).alias("control"), v.alias("figure"), F.lit(f"at least {least}").alias("allowed"), F.when(v < least, FAIL).otherwise(PASS).alias("status")) for c, v, least in cells))
    return sizes.select(PANEL, F.explode(rows).alias("x")).select(PANEL, "x.*").where(F.col("status") == FAIL)


def without_failures(checks: DataFrame) -> DataFrame:
    """panel of each panel that fails no check; raises if all fail, with examples."""
    fit = checks.groupBy(PANEL).agg(F.max((F.col("status") == FAIL).cast("int")).alias("bad")).where("bad = 0").select(PANEL)
    if not fit.limit(1).count():
        refuse_failures(checks)
    return fit


def refuse_failures(checks: DataFrame) -> None:
    """Raise if a check has failed."""
    failed = checks.where(F.col("status") == FAIL).limit(20).collect()
    if failed:
        raise ValueError("data quality: " + "; ".join(f"{r.panel}: {r.control} ({r.figure}, allowed {r.allowed})" for r in failed))


def _apart(p: int, k: int):
    """A model against the QR tree's spectrum: gaps of eigenvalues, of the projectors on the first k factors, and of means."""

    def run(batch):
        vectors = np.array([np.stack(v)[:k] for v in batch["vectors"]])
        own = np.array([np.stack(v)[:k] for v in batch["components"]])
        project = lambda v: v.transpose(0, 2, 1) @ v
        gap = lambda a, b: np.abs(factors.stacked(batch[a], p) - factors.stacked(batch[b], p)).max(axis=1).tolist()
        return {"value_gap": gap("own_values", "eigenvalues"), "projector_gap": np.abs(project(vectors) - project(own)).max(axis=(1, 2)).tolist(), "mean_gap": gap("mean", "center")}

    return run


def algebra_checks(changes: DataFrame, model: DataFrame, moment_rows: DataFrame, nodes: Nodes, k: int = 3, tolerance: float = 1e-10, least_similarity: float = 0.70, least_margin: float = 0.10, standardized: bool = False, weight: Column | None = None) -> DataFrame:
    """Errors of each panel's model against routes of their own: panel, control, result, threshold, status.

    Spark rebuilds the covariance from components, and the eigenvalues from variances of the scores, and carries scores
    back to changes. Means, eigenvalues and the projector on the first k factors are held against a QR tree of the changes
    themselves (:mod:`.tsqr`), so that a fault of the moments is seen too. Tolerances are relative to the size of what is
    compared. ``weight``: that of a weighted model; its scores have other variances by design and are not compared.
    """
    p, names = len(nodes.names), nodes.names
    rows = factors.with_model(changes, model).withColumn("s", factors.score_array(vector(names))).withColumn("back", factors.inverse_array(F.col("s"), p, p))
    trip = rows.groupBy(PANEL).agg(
        F.max(F.greatest(*(F.abs(F.col("back")[i] - col(n)) for i, n in enumerate(names)))).alias("round_trip"),
        *(F.covar_samp(F.col("s")[i], F.col("s")[j]).alias(f"v{i}_{j}") for i in range(p) for j in range(i, p)),
    )
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    cov = lambda i, j: F.col("cov")[i * p + j] / (F.col("scale")[i] * F.col("scale")[j])
    b = model.join(moment_rows.select(PANEL, "cov"), PANEL).join(trip, PANEL)
    apart = spectrum(changes, names, weight, standardized).select(PANEL, "mean", "vectors", F.col("eigenvalues").alias("own_values"))
    both = b.select(PANEL, "center", "eigenvalues", "components").join(apart, PANEL).where("center IS NOT NULL AND own_values IS NOT NULL")
    b = b.join(factors.per_batch(both, _apart(p, k), [PANEL], "value_gap double, projector_gap double, mean_gap double"), PANEL)
    unit = F.greatest(*(F.abs(factors.dot(F.col("components")[i], F.col("components")[j]) - (1.0 if i == j else 0.0)) for i in range(p) for j in range(i, p)))
    product = lambda i, j: add(F.zip_with("components", "eigenvalues", lambda v, e: v[i] * v[j] * e))
    rebuilt = F.greatest(*(F.abs(cov(i, j) - product(i, j)) for i in range(p) for j in range(i, p)))
    top = F.col("eigenvalues")[0]
    deviation = F.greatest(F.sqrt(top), F.lit(1.0))
    eigen = F.greatest(*(F.abs(F.col(f"v{i}_{i}") - F.col("eigenvalues")[i]) for i in range(p)), F.lit(0.0))
    off = F.greatest(*(F.abs(F.col(f"v{i}_{j}")) for i in range(p) for j in range(i + 1, p)), F.lit(0.0))
    checks = [
        ("Round trip", F.col("round_trip") / deviation, tolerance, True),
        ("Orthonormal components", unit, tolerance, True),
        ("Covariance rebuilt", rebuilt / top, tolerance, True),
        ("Score variances", eigen / top, 1e-8, True),
        ("Score covariances", off / top, 1e-8, True),
        ("Least template similarity", F.array_min("similarity"), least_similarity, False),
        ("Least template margin", F.array_min("margin"), least_margin, False),
        ("Singular values", F.col("value_gap") / top, 1e-8, True),
        ("Projector", F.col("projector_gap"), 1e-6, True),
        ("Means", F.col("mean_gap") / deviation, 1e-8, True),
    ]
    if weight is not None:
        checks = [x for x in checks if not x[0].startswith("Score")]
    if standardized:
        checks.append(("Unit diagonal", F.greatest(*(F.abs(cov(i, i) - 1) for i in range(p))), tolerance, True))
    made = F.array(
        *(
            F.struct(F.lit(n).alias("control"), v.alias("result"), F.lit(float(t)).alias("threshold"), F.when((v <= t) if low else (v >= t), PASS).otherwise(FAIL if low else WARN).alias("status"))
            for n, v, t, low in checks
        )
    )
    return b.select(PANEL, F.explode(made).alias("x")).select(PANEL, "x.*")


def monitor(table: DataFrame, name: str, result, threshold: float, lower_is_better: bool = True, panels: DataFrame | None = None) -> DataFrame:
    """One health row for each panel: panel, monitor, result, threshold, status. A null result warns, and so does a panel of ``panels`` that ``table`` lacks."""
    r = table.groupBy(PANEL).agg(result.cast("double").alias("result"))
    r = panels.join(r, PANEL, "left") if panels is not None else r
    ok = (F.col("result") <= threshold) if lower_is_better else (F.col("result") >= threshold)
    return r.select(PANEL, F.lit(name).alias("monitor"), "result", F.lit(float(threshold)).alias("threshold"), F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(WARN).alias("status"))


def health_table(rolling: DataFrame, oos_metrics: DataFrame, sequential: DataFrame | None = None, recency: DataFrame | None = None, methodology: DataFrame | None = None, max_angle: float = 30, min_cosine: float = 0.80, max_rmse: float = 5, max_sigma_ratio: float = 1.25, max_method_angle: float = 15, max_method_ratio: float = 1.25, panels: DataFrame | None = None) -> DataFrame:
    """Monitors of a model's stability; with ``panels`` every one of them has every row, with a warning where nothing was evaluated."""
    ratio = F.max(F.greatest(F.col("sigma_ratio"), 1 / F.col("sigma_ratio")))
    specs = [(rolling, "Rolling subspace angle", F.max("max_angle"), max_angle, True), (rolling, "Rolling loading cosine", F.min(F.array_min("cosines")), min_cosine, False), (oos_metrics.where("node is not null"), "Out-of-sample RMSE", F.max("rmse"), max_rmse, True)]
    if sequential is not None:
        specs += [(sequential, "Sequential subspace angle", F.max("max_angle"), max_angle, True), (sequential, "Sequential loading cosine", F.min("min_cosine"), min_cosine, False)]
        specs += [(sequential, "Latest sequential angle", F.max_by("max_angle", "window_end"), max_angle, True), (sequential, "Latest sequential cosine", F.max_by("min_cosine", "window_end"), min_cosine, False)]
    if recency is not None:
        specs += [(recency, "Recency subspace angle", F.max("principal_angle"), max_angle, True), (recency, "Recency sigma ratio", ratio, max_sigma_ratio, True)]
    if methodology is not None:
        specs += [(methodology, "Methodology subspace angle", F.max("principal_angle"), max_method_angle, True), (methodology, "Methodology sigma ratio", ratio, max_method_ratio, True)]
    rows = [monitor(*spec, panels) for spec in specs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def assessment(*tables: DataFrame) -> DataFrame:
    """panel, assessment: any FAIL needs revision, any WARN (or what was not evaluated or is inconclusive) caveats, else ready."""
    all_rows = tables[0].select(PANEL, "status")
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t.select(PANEL, "status"))
    severity = F.max(F.when(F.col("status") == FAIL, 2).when(F.col("status").isin(WARN, "NOT EVALUATED", "INCONCLUSIVE"), 1).otherwise(0))
    return all_rows.groupBy(PANEL).agg(severity.alias("s")).select(PANEL, F.when(F.col("s") == 2, NEEDS_REVISION).when(F.col("s") == 1, WITH_CAVEATS).otherwise(READY).alias("assessment"))


def no_look_ahead(audited: DataFrame) -> DataFrame:
    """Rows of an out-of-sample table whose training reaches their own date (there must be none)."""
    return audited.where(F.col("training_end") >= F.col(DATE))


def positions_are_dense(changes: DataFrame) -> DataFrame:
    """Panels whose positions are not 0, 1, ..., n - 1."""
    w = Window.partitionBy(PANEL).orderBy(DATE)
    return changes.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") != F.col(POS)).select(PANEL).distinct()
