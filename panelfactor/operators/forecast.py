"""Walk-forward forecasts of node changes, and the gate that a model must pass to replace no change.

At every origin the centred moments of all earlier rows (running, never the rows) give a covariance, its
factors and, from lagged co-moments rotated into factor space, the factors' AR(1) and VAR(1). One
origin is one small row, so origins of all panels are worked on in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import expanding_moments
from ..functions.stats import hac_test, one_sided
from ..schema import DATE, PANEL, PERIOD_END, POS, Nodes, col, vector
from . import factors

NO_CHANGE, MEAN, AR, VAR = "No change", "Historical mean", "Factor AR(1)", "Factor VAR(1)"
MODELS = (NO_CHANGE, MEAN, AR, VAR)


def factor_forecasts(n, mean, m2, cross, x_first, x_last, templates, k, bound, ridge) -> dict:
    """Mean, AR(1) and VAR(1) forecasts of the next change from centred moments of the first ``n`` rows, for a stack of origins.

    AR slopes are least squares clipped to +-bound; the VAR's ridge acts on slopes of scores in units of their
    deviation, and its transition is shrunk to spectral radius ``bound``. Intercepts follow from the means. Origins with a
    node that has not moved have no factors: their AR and VAR forecasts are None.
    """
    p = mean.shape[1]
    n = n[:, None]
    cov = m2 / (n[:, :, None] - 1)
    model = factors.decompose_many(mean, cov, templates)
    known = np.array([v is not None for v in model["center"]], bool)
    unit = np.eye(p)[:k]
    basis = np.array([np.stack(v)[:k] if v is not None else unit for v in model["components"]])
    deviation = np.sqrt(np.array([v[:k] if v is not None else np.ones(k) for v in model["eigenvalues"]]))
    m = n - 1
    turned = lambda x: np.einsum("akp,ap->ak", basis, x)
    inside = lambda x: basis @ x @ basis.transpose(0, 2, 1)
    outer = lambda a, b: a[:, :, None] * b[:, None, :]
    # the sample without its first row, and without its last: one row is taken out of the centred moments
    now, past = (n * mean - x_first) / m, (n * mean - x_last) / m
    past_cov = inside(m2 - (n / m)[:, :, None] * outer(x_last - mean, x_last - mean))
    cross = inside(cross)  # rows: now, columns: past
    now_s, past_s, last_s = turned(now - mean), turned(past - mean), turned(x_last - mean)
    own = np.diagonal(past_cov, axis1=1, axis2=2)
    moving = own > factors.TINY
    slope = np.where(moving, np.clip(np.diagonal(cross, axis1=1, axis2=2) / np.where(moving, own, 1), -bound, bound), 0.0)
    ar = now_s + slope * (last_s - past_s)
    spread = (deviation > factors.TINY).all(axis=1)
    safe = np.where(spread[:, None], deviation, 1.0)
    left = past_cov / outer(safe, safe) + ridge * np.eye(k)
    right = (cross / outer(safe, safe)).transpose(0, 2, 1)
    left = np.where((known & spread)[:, None, None], left, np.eye(k))
    try:
        transition = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        transition = np.linalg.pinv(left) @ right
    radius = np.abs(np.linalg.eigvals(transition)).max(axis=1)
    transition = transition * np.where(radius > bound, bound / np.where(radius > 0, radius, 1), 1.0)[:, None, None]
    var = (now_s / safe + np.einsum("ak,akj->aj", (last_s - past_s) / safe, transition)) * safe
    var = np.where(spread[:, None], var, 0.0)
    back = lambda scores: [mean[a] + scores[a] @ basis[a] if known[a] else None for a in range(len(mean))]
    return {"mean": list(mean), "ar": back(ar), "var": back(var)}


_FORECASTS = "mean array<double>, ar array<double>, var array<double>"


def _kernel(nodes: Nodes, k: int, bound: float, ridge: float):
    templates, p = factors.shape_templates(nodes.maturities), len(nodes.names)

    def run(batch):
        shapes = {"mean": (p,), "m2": (p, p), "cross": (p, p), "x_first": (p,), "x_last": (p,)}
        return factor_forecasts(batch["n_train"].to_numpy(float), *(factors.stacked(batch[c], *shape) for c, shape in shapes.items()), templates, k, bound, ridge)

    return run


def check_inputs(changes: DataFrame, nodes: Nodes, train: int, weekly: DataFrame | None = None, tolerance: float = 1e-8) -> None:
    """An error unless every panel can be walked through: enough rows, finite numbers, positions without gaps and, with
    ``weekly``, changes that are those of its levels to ``tolerance``.
    """
    if train < 3:
        raise ValueError("training needs three rows")
    if missing := [c for c in (PANEL, DATE, POS, *nodes.names) if c not in changes.columns]:
        raise ValueError(f"changes lack {missing}")
    finite = F.lit(True)
    for n in nodes.names:
        finite = finite & F.coalesce(F.abs(col(n)) < float("inf"), F.lit(False))
    told = changes.groupBy(PANEL).agg(F.count("*").alias("n"), F.count_if(~finite).alias("bad"), F.countDistinct(POS).alias("places"), F.max(POS).alias("last"))
    wrong = told.where((F.col("bad") > 0) | (F.col("places") != F.col("n")) | (F.col("last") != F.col("n") - 1) | (F.col("n") <= train)).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.panel}: {r.n} changes (training {train}), {r.bad} not finite, last position {r.last}" for r in wrong))
    if weekly is not None:
        off = reconciliation(weekly, changes, nodes).where((F.col("max_difference") > tolerance) | F.isnan("max_difference") | (F.col("n_levels") != F.col("n_changes") + 1)).limit(5).collect()
        if off:
            raise ValueError("; ".join(f"{r.panel}: changes differ from levels by {r.max_difference}, {r.n_changes} of {r.n_levels} levels" for r in off))


def walk_forward(changes: DataFrame, nodes: Nodes, train: int, k: int = 3, bound: float = 0.995, ridge: float = 1e-3) -> DataFrame:
    """panel, date, pos, model, node, actual, fitted for every row from position ``train`` on.

    The row at pos is forecast from rows before pos only.
    """
    names = nodes.names
    seen = expanding_moments(changes, names).where(F.col(POS) >= train).select(PANEL, DATE, POS, F.col(POS).alias("n_train"), "mean", "m2", "cross", "x_first", "x_last", vector(names).alias("actual"))
    # a chunk's window leaves its origins in one task: deal them out again for the kernel
    origins = seen.repartition(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), PANEL, POS)
    made = factors.per_batch(origins, _kernel(nodes, k, bound, ridge), [PANEL, DATE, POS, "actual"], _FORECASTS)
    zero = F.transform("actual", lambda _: F.lit(0.0))
    models = F.array(*(F.struct(F.lit(m).alias("model"), c.alias("fitted")) for m, c in ((NO_CHANGE, zero), (MEAN, F.col("mean")), (AR, F.col("ar")), (VAR, F.col("var")))))
    rows = made.select(PANEL, DATE, POS, "actual", F.explode(models).alias("m"))
    cells = F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("node"), F.col("actual"), F.col("m.fitted").alias("fitted"))
    return rows.select(PANEL, DATE, POS, "m.model", F.explode(cells).alias("x")).select(PANEL, DATE, POS, "model", "x.node", "x.actual", "x.fitted")


def simple_forecasts(changes: DataFrame, nodes: Nodes, train: int) -> DataFrame:
    """No-change and historical-mean forecasts alone, without any kernel."""
    before = Window.partitionBy(PANEL).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    rows = changes.select(PANEL, DATE, POS, F.array(*(F.struct(F.lit(n).alias("node"), col(n).alias("actual"), F.avg(col(n)).over(before).alias("mean")) for n in nodes.names)).alias("x")).where(F.col(POS) >= train)
    long = rows.select(PANEL, DATE, POS, F.explode("x").alias("x"))
    models = F.array(F.struct(F.lit(NO_CHANGE).alias("model"), F.lit(0.0).alias("fitted")), F.struct(F.lit(MEAN).alias("model"), F.col("x.mean").alias("fitted")))
    return long.select(PANEL, DATE, POS, "x.node", "x.actual", F.explode(models).alias("m")).select(PANEL, DATE, POS, "m.model", "node", "actual", "m.fitted")


def node_ar1(changes: DataFrame, nodes: Nodes, train: int) -> DataFrame:
    """Expanding AR(1) of each node by windowed regression: panel, date, pos, node, actual, fitted."""
    order = Window.partitionBy(PANEL, "node").orderBy(POS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    long = changes.select(PANEL, DATE, POS, F.explode(F.array(*(F.struct(F.lit(n).alias("node"), col(n).alias("actual")) for n in nodes.names))).alias("x")).select(PANEL, DATE, POS, "x.*")
    pairs = long.withColumn("past", F.lag("actual").over(order))
    known = F.col("past").isNotNull()
    slope = F.covar_pop("actual", "past").over(before) / F.var_pop(F.when(known, F.col("past"))).over(before)
    fitted = F.avg(F.when(known, F.col("actual"))).over(before) + slope * (F.col("past") - F.avg("past").over(before))
    return pairs.withColumn("fitted", fitted).where(F.col(POS) >= train).select(PANEL, DATE, POS, "node", "actual", "fitted")


def forecast_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE, bias and direction accuracy for each model and node, and pooled (node null).

    Direction counts rows where actual and forecast both differ from zero; null if there are none.
    """
    e = predictions.withColumn("e", F.col("fitted") - F.col("actual"))
    both = (F.col("actual") != 0) & (F.col("fitted") != 0)
    e = e.withColumn("right", F.when(both, (F.signum("actual") == F.signum("fitted")).cast("double")))
    g = e.groupingSets([[F.col(PANEL), F.col("model"), F.col("node")], [F.col(PANEL), F.col("model")]], F.col(PANEL), F.col("model"), F.col("node"))
    return g.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.avg("right").alias("direction_accuracy"))


def loss_advantages(predictions: DataFrame, benchmark: str = NO_CHANGE, keep=()) -> DataFrame:
    """Per row and model, averaged over nodes: squared-loss advantage over the benchmark, raw and Clark-West adjusted."""
    same = Window.partitionBy(PANEL, POS, "node")  # rows: one for each model
    both = predictions.withColumn("base", F.max(F.when(F.col("model") == benchmark, F.col("fitted"))).over(same))
    eb, ec, d = F.col("actual") - F.col("base"), F.col("actual") - F.col("fitted"), F.col("base") - F.col("fitted")
    return both.groupBy(PANEL, "model", DATE, POS, *keep).agg(F.avg(eb * eb - ec * ec).alias("raw"), F.avg(eb * eb - ec * ec + d * d).alias("adjusted"), F.avg(ec * ec).alias("loss"))


def partition_of(pos: Column, n_rows: Column, evaluation: int, confirmation: int) -> Column:
    """Selection, Confirmation or Interval evaluation, by position in the panel."""
    return F.when(pos >= n_rows - evaluation, "Interval evaluation").when(pos >= n_rows - evaluation - confirmation, "Confirmation").otherwise("Selection")


def partitioned(predictions: DataFrame, evaluation: int, confirmation: int) -> DataFrame:
    """Predictions with n_rows (rows of the panel up to its last prediction) and their partition."""
    n = F.max(POS).over(Window.partitionBy(PANEL)) + 1
    return predictions.withColumn("n_rows", n).withColumn("partition", partition_of(F.col(POS), F.col("n_rows"), evaluation, confirmation))


def adoption_gate(predictions: DataFrame, evaluation: int, confirmation: int, alpha: float = 0.05, least_improvement: float = 0.01, lags: int = 4) -> DataFrame:
    """One row for each panel and model: selection and confirmation evidence, whether it is adopted, and selected.

    A model must beat no change by the least RMSE improvement with a positive Clark-West statistic, at
    alpha / 3 in the selection sample; the best of those by RMSE must do so again at alpha in the
    confirmation sample, or no change stays.
    """
    parts = partitioned(predictions, evaluation, confirmation).where(F.col("partition") != "Interval evaluation")
    losses = loss_advantages(parts, keep=("partition",)).persist()  # a row for each origin and model, read three times
    keys = (PANEL, "model", "partition")
    rmse = losses.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.sqrt(F.avg("loss")).alias("rmse"))
    raw = hac_test(losses, keys, POS, "raw", lags).withColumnsRenamed({"mean": "advantage", "statistic": "hac", "p_value": "hac_p"}).drop("n")
    cw = hac_test(losses, keys, POS, "adjusted", lags).withColumn("cw_p", one_sided(F.col("statistic"), F.col("p_value"))).withColumnsRenamed({"mean": "cw_advantage", "statistic": "cw"}).drop("n", "p_value")
    base = rmse.where(F.col("model") == NO_CHANGE).select(PANEL, "partition", F.col("rmse").alias("base_rmse"))
    side = rmse.join(raw, list(keys)).join(cw, list(keys)).join(base, [PANEL, "partition"])
    side = side.withColumn("improvement", F.when(F.col("base_rmse") > 0, 1 - F.col("rmse") / F.col("base_rmse")))
    level = F.when(F.col("partition") == "Selection", alpha / (len(MODELS) - 1)).otherwise(alpha)
    passes = (F.col("model") != NO_CHANGE) & (F.col("improvement") > least_improvement) & (F.col("cw") > 0) & (F.col("cw_p") < level)
    side = side.withColumn("alpha", level).withColumn("passes", F.coalesce(passes, F.lit(False)))
    figures = ["rows", "first_date", "last_date", "rmse", "improvement", "advantage", "hac", "hac_p", "cw_advantage", "cw", "cw_p", "alpha", "passes"]
    pick = lambda part: side.where(F.col("partition") == part).select(PANEL, "model", *(F.col(c).alias(f"{part.lower()}_{c}") for c in figures))
    table = pick("Selection").join(pick("Confirmation"), [PANEL, "model"])
    best = F.min_by(F.when(F.col("selection_passes"), F.col("model")), F.when(F.col("selection_passes"), F.struct("selection_rmse", "model"))).over(Window.partitionBy(PANEL))  # rows: one for each model
    table = table.withColumn("adopted", F.coalesce((F.col("model") == best) & F.col("confirmation_passes"), F.lit(False)))
    any_adopted = F.max("adopted").over(Window.partitionBy(PANEL))
    return table.withColumn("selected", F.col("adopted") | (~any_adopted & (F.col("model") == NO_CHANGE)))


def latest_forecast(weekly: DataFrame, changes: DataFrame, gate: DataFrame, nodes: Nodes, k: int = 3, bound: float = 0.995, ridge: float = 1e-3) -> DataFrame:
    """Next change of each node by the selected model: panel, as_of, target_period_end, model, node, level, change, forecast_level."""
    names = nodes.names
    ended = changes.withColumn("_end", F.col(POS) == F.col("n_rows") - 1)
    p = len(names)
    order = Window.partitionBy(PANEL).orderBy(POS)
    lagged = ended.select("*", *(F.lag(col(n)).over(order).alias(f"_l{i}") for i, n in enumerate(names)))
    known, zero = F.col("_l0").isNotNull(), F.lit(0.0)
    cell = lambda a, j: F.coalesce(F.covar_pop(F.when(known, col(a)), F.col(f"_l{j}")), zero) * F.count("_l0")
    sums = lagged.groupBy(PANEL).agg(
        F.count("*").alias("n_train"), F.array(*(F.avg(col(n)) for n in names)).alias("mean"), F.array(*(F.covar_pop(col(a), col(b)) * F.count("*") for a in names for b in names)).alias("m2"),
        F.array(*(cell(a, j) for a in names for j in range(p))).alias("cross"), F.min_by(vector(names), POS).alias("x_first"), F.max_by(vector(names), POS).alias("x_last"),
    )
    made = factors.per_batch(sums, _kernel(nodes, k, bound, ridge), [PANEL], _FORECASTS)
    chosen = gate.where("selected").select(PANEL, "model")
    last = weekly.groupBy(PANEL).agg(F.max_by(F.struct(DATE, PERIOD_END, vector(names).alias("level")), DATE).alias("x")).select(PANEL, "x.*")
    rows = last.join(made, PANEL).join(chosen, PANEL)
    change = F.when(F.col("model") == MEAN, F.col("mean")).when(F.col("model") == AR, F.col("ar")).when(F.col("model") == VAR, F.col("var")).otherwise(F.transform("level", lambda _: F.lit(0.0)))
    cells = F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("node"), F.col("level"), change.alias("change"))
    out = rows.select(PANEL, F.col(DATE).alias("as_of"), F.date_add(PERIOD_END, 7).alias("target_period_end"), "model", F.explode(cells).alias("x"))
    return out.select(PANEL, "as_of", "target_period_end", "model", "x.node", "x.level", "x.change", (F.col("x.level") + F.col("x.change") / 100).alias("forecast_level"))


def reconciliation(weekly: DataFrame, changes: DataFrame, nodes: Nodes, scale: float = 100.0) -> DataFrame:
    """Largest difference between a panel's changes and those of its levels, and counts of both."""
    by_date = Window.partitionBy(PANEL).orderBy(DATE)
    again = weekly.select(PANEL, DATE, *(((col(n) - F.lag(col(n)).over(by_date)) * scale).alias(f"_{i}") for i, n in enumerate(nodes.names)))
    met = changes.join(again, [PANEL, DATE], "left")
    worst = F.max(F.greatest(*(F.coalesce(F.abs(col(n) - F.col(f"_{i}")), F.lit(float("inf"))) for i, n in enumerate(nodes.names))))
    return met.groupBy(PANEL).agg(worst.alias("max_difference"), F.count("*").alias("n_changes")).join(weekly.groupBy(PANEL).agg(F.count("*").alias("n_levels")), PANEL)
