"""First-order risk of node sensitivities: P&L and its factors, tails, back-tests, scenarios, hedges.

Sensitivities (``dv01``: panel, node, dv01 in USD per basis point, positive when falling values gain) are a
table; a panel may be a portfolio on its own curve. P&L is -change . dv01.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sliding import sliding_ranks
from ..functions.stats import coverage_tests
from ..schema import DATE, GAP, PANEL, POS, Nodes, vector
from . import factors

TINY = 2.220446049250313e-16


def dv01_defects(dv01: DataFrame, panels: DataFrame, nodes: Nodes) -> DataFrame:
    """(panel, node, defect): absent, unknown, repeated or non-finite sensitivities, by anti-joins both ways."""
    wanted = panels.select(PANEL).distinct().withColumn("node", F.explode(F.array(*(F.lit(n) for n in nodes.names))))
    absent = wanted.join(dv01, [PANEL, "node"], "left_anti").select(PANEL, "node", F.lit("absent").alias("defect"))
    unknown = dv01.where(~F.col("node").isin(list(nodes.names)) | F.col("node").isNull()).select(PANEL, "node", F.lit("unknown").alias("defect"))
    repeated = dv01.groupBy(PANEL, "node").count().where("count > 1").select(PANEL, "node", F.lit("repeated").alias("defect"))
    bad = dv01.where(F.col("dv01").isNull() | F.isnan("dv01") | (F.abs("dv01") == float("inf"))).select(PANEL, "node", F.lit("not finite").alias("defect"))
    return absent.unionByName(unknown).unionByName(repeated).unionByName(bad)


def dv01_vectors(dv01: DataFrame, nodes: Nodes) -> DataFrame:
    """panel, dv01 as one array in node order."""
    return dv01.groupBy(PANEL).agg(F.array(*(F.max(F.when(F.col("node") == n, F.col("dv01"))) for n in nodes.names)).alias("dv01"))


def same_for_all(panels: DataFrame, nodes: Nodes, values) -> DataFrame:
    """One sensitivity vector for every panel, as a table."""
    cells = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(float(v)).alias("dv01")) for n, v in zip(nodes.names, values, strict=True)))
    return panels.select(PANEL).distinct().select(PANEL, F.explode(cells).alias("x")).select(PANEL, "x.*")


def linear_pnl(changes: DataFrame, dv01: DataFrame, nodes: Nodes) -> DataFrame:
    """panel, date, pos, n_rows, gap_days, pnl of each row."""
    rows = changes.join(dv01_vectors(dv01, nodes), PANEL)
    return rows.select(PANEL, DATE, POS, "n_rows", GAP, (-factors.dot(vector(nodes.names), F.col("dv01"))).alias("pnl"))


def exposures(physical: Column, dv01: Column) -> Column:
    """Sensitivity to each factor's score: -basis . dv01."""
    return F.transform(physical, lambda b: -factors.dot(b, dv01))


def factor_pnl(changes: DataFrame, dv01: DataFrame, model: DataFrame, nodes: Nodes, k: int = 3) -> DataFrame:
    """Full P&L of each row split into the first k factors, the mean change and a residual (long: panel, date, pos, source, pnl)."""
    rows = factors.with_model(changes, model).join(dv01_vectors(dv01, nodes), PANEL)
    rows = rows.select(PANEL, DATE, POS, "labels", (-factors.dot(vector(nodes.names), F.col("dv01"))).alias("full"), (-factors.dot(F.col("center"), F.col("dv01"))).alias("mean"), factors.score_array(vector(nodes.names)).alias("scores"), exposures(F.col("physical"), F.col("dv01")).alias("exposure"))
    parts = [F.struct(F.col("labels")[j].alias("source"), (F.col("scores")[j] * F.col("exposure")[j]).alias("pnl")) for j in range(k)]
    residual = F.col("full") - F.col("mean") - sum((F.col("scores")[j] * F.col("exposure")[j] for j in range(k)), F.lit(0.0))
    parts += [F.struct(F.lit(name).alias("source"), c.alias("pnl")) for name, c in (("Mean change", F.col("mean")), ("Residual", residual), ("Full", F.col("full")))]
    return rows.select(PANEL, DATE, POS, F.explode(F.array(*parts)).alias("x")).select(PANEL, DATE, POS, "x.source", "x.pnl")


def var_rank(n: int, confidence: float) -> int:
    """1-based rank, from the smallest loss, of the predictive order statistic: ceil((n + 1) c), at most n."""
    if not 0.5 < confidence < 1:
        raise ValueError("confidence must lie in (0.5, 1)")
    return min(n, math.ceil((n + 1) * confidence))


def tail_summary(pnl: DataFrame, window: int | None, var_confidence: float = 0.99, es_confidence: float = 0.975, review_mass: float = 20, least_rows: int = 52) -> DataFrame:
    """VaR (predictive order statistic) and ES (fractional tail average) of each panel, over its last ``window`` rows or all.

    Panels with fewer than ``least_rows`` rows are left out. Losses are ranked inside a panel; only ranks in the
    tail enter the sums.
    """
    scoped = pnl.where(F.col(POS) >= F.col("n_rows") - window) if window else pnl
    worst = Window.partitionBy(PANEL).orderBy(F.col("pnl"), F.col(DATE))
    ranked = scoped.select(PANEL, DATE, (-F.col("pnl")).alias("loss"), F.row_number().over(worst).alias("place"), F.count("*").over(Window.partitionBy(PANEL)).alias("n"))
    n, place = F.col("n"), F.col("place")
    rank = F.least(n, F.ceil((n + 1) * F.lit(var_confidence)).cast("long"))
    mass = lambda c: n * (1 - F.lit(c))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mass(es_confidence) - (place - 1)))
    g = ranked.groupBy(PANEL, "n").agg(F.max(F.when(place == n - rank + 1, F.col("loss"))).alias("var"), (F.sum(F.col("loss") * weight) / F.max(mass(es_confidence))).alias("es"), F.min(DATE).alias("window_start"), F.max(DATE).alias("window_end"))
    bound = (n + 1 - rank) / (n + 1)
    scope = F.lit("full" if window is None else f"latest {window}").alias("scope")
    measures = F.array(
        F.struct(F.lit("VaR").alias("measure"), F.lit(var_confidence).alias("confidence"), F.col("var").alias("loss"), mass(var_confidence).alias("tail_mass"), rank.cast("long").alias("rank"), bound.alias("exception_bound"), (bound <= 1 - var_confidence + TINY).alias("attainable")),
        F.struct(F.lit("ES").alias("measure"), F.lit(es_confidence).alias("confidence"), F.col("es").alias("loss"), mass(es_confidence).alias("tail_mass"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("exception_bound"), F.lit(None).cast("boolean").alias("attainable")),
    )
    rows = g.where(n >= least_rows).select(PANEL, scope, "n", "window_start", "window_end", F.explode(measures).alias("x")).select(PANEL, "scope", "n", "window_start", "window_end", "x.*")
    return rows.withColumn("status", F.when(F.col("tail_mass") >= review_mass, "REVIEW LEVEL MET").otherwise("BELOW REVIEW LEVEL"))


def backtest_detail(pnl: DataFrame, window: int, confidence: float = 0.99) -> DataFrame:
    """Each row after the first ``window``: VaR of exactly that many rows before it, realised loss, strict exceedance."""
    rank = var_rank(window, confidence)
    losses = pnl.select(PANEL, DATE, POS, (-F.col("pnl")).alias("loss"))
    ranked = sliding_ranks(losses, [PANEL], POS, "loss", window, [rank], carried=[DATE])
    out = ranked.where(F.col(POS) >= window).select(PANEL, DATE, POS, F.col(f"{DATE}_first").alias("estimation_start"), F.col(f"{DATE}_last").alias("estimation_end"), F.col("q")[0].alias("var"), "loss")
    return out.withColumn("exception", F.col("loss") > F.col("var"))


def backtest_summary(detail: DataFrame, window: int, confidence: float = 0.99, alpha: float = 0.05, least_rows: int = 250) -> DataFrame:
    """Kupiec, Christoffersen and joint tests of a back-test against the finite-sample exception bound.

    NOT EVALUATED with too few rows or if the window can't attain the confidence; figures of the tests are then null.
    """
    bound = (window + 1 - var_rank(window, confidence)) / (window + 1)
    attainable = bound <= 1 - confidence + TINY
    t = coverage_tests(detail, [PANEL], POS, "exception", F.lit(bound))
    ok = (F.col("n") >= least_rows) & F.lit(attainable)
    tests = ["kupiec_lr", "kupiec_p", "independence_lr", "independence_p", "joint_lr", "joint_p"]
    status = F.when(~ok, "NOT EVALUATED").when(F.least("kupiec_p", "independence_p", "joint_p") >= alpha, "PASS").otherwise("WARN")
    return t.select(PANEL, F.lit(window).alias("window"), F.lit(confidence).alias("confidence"), "n", "exceptions", (F.col("n") * bound).alias("expected"), F.lit(bound).alias("exception_bound"), F.lit(var_rank(window, confidence)).alias("rank"), F.lit(attainable).alias("attainable"), (F.col("exceptions") / F.col("n")).alias("rate"), *(F.when(ok, F.col(c)).alias(c) for c in tests), status.alias("status"))


def worst_scenarios(changes: DataFrame, dv01: DataFrame, nodes: Nodes, count: int = 10, window: int | None = None) -> DataFrame:
    """The ``count`` most negative rows of each panel with their previous date, horizon and shocks; ties go to the earlier date."""
    rows = changes.join(dv01_vectors(dv01, nodes), PANEL).withColumn("pnl", -factors.dot(vector(nodes.names), F.col("dv01")))
    rows = rows.withColumn("previous_date", F.lag(DATE).over(Window.partitionBy(PANEL).orderBy(POS)))
    rows = rows.where(F.col(POS) >= F.col("n_rows") - window) if window else rows
    place = F.row_number().over(Window.partitionBy(PANEL).orderBy("pnl", DATE))
    out = rows.withColumn("place", place).where(F.col("place") <= count)
    return out.select(PANEL, "place", DATE, "previous_date", F.datediff(DATE, "previous_date").alias("horizon_days"), "pnl", *(F.col(f"`{n}`").alias(f"shock_{n}") for n in nodes.names))


def factor_scenarios(model: DataFrame, dv01: DataFrame, nodes: Nodes, k: int = 3, multiples=(1, 2, 3)) -> DataFrame:
    """Shocks of whole multiples of each factor's deviation, both ways: panel, factor, multiple, pnl, shocks."""
    rows = model.join(dv01_vectors(dv01, nodes), PANEL).select(PANEL, "dv01", "eigenvalues", "labels", F.posexplode(F.slice("physical", 1, k)).alias("j", "basis"))
    rows = rows.withColumn("multiple", F.explode(F.array(*(F.lit(float(s * m)) for m in multiples for s in (-1, 1)))))
    shock = F.transform("basis", lambda b: F.col("multiple") * F.sqrt(F.col("eigenvalues")[F.col("j")]) * b)
    rows = rows.withColumn("shock", shock)
    return rows.select(PANEL, (F.col("j") + 1).alias("factor"), F.col("labels")[F.col("j")].alias("label"), "multiple", (-factors.dot(F.col("shock"), F.col("dv01"))).alias("pnl"), *(F.col("shock")[i].alias(f"shock_{n}") for i, n in enumerate(nodes.names)))


def variance_table(model: DataFrame, dv01: DataFrame, nodes: Nodes, k: int = 3) -> DataFrame:
    """P&L variance by factor, residual factors and total (long: panel, source, variance, share), and whether the parts reconcile.

    The total is dv01' (B' L B) dv01 from the rebuilt covariance, a route of its own.
    """
    p = len(nodes.names)
    rows = model.join(dv01_vectors(dv01, nodes), PANEL).withColumn("e", exposures(F.col("physical"), F.col("dv01")))
    own = F.zip_with("e", "eigenvalues", lambda e, v: e * e * v)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    cov = lambda i, j: add(F.zip_with("physical", "eigenvalues", lambda b, v: b[i] * b[j] * v))
    total = sum((F.col("dv01")[i] * F.col("dv01")[j] * cov(i, j) for i in range(p) for j in range(p)), F.lit(0.0))
    rows = rows.withColumn("own", own).withColumn("total", total).withColumn("rest", add(F.slice(F.col("own"), k + 1, max(p - k, 1))) if p > k else F.lit(0.0))
    parts = [F.struct(F.col("labels")[j].alias("source"), F.col("own")[j].alias("variance")) for j in range(k)]
    parts += [F.struct(F.lit("Residual").alias("source"), F.col("rest").alias("variance")), F.struct(F.lit("Total").alias("source"), F.col("total").alias("variance"))]
    gap = F.abs(F.col("total") - add(F.slice(F.col("own"), 1, k)) - F.col("rest"))
    out = rows.select(PANEL, "total", (gap <= 1e-6 + 1e-10 * F.abs("total")).alias("reconciled"), F.explode(F.array(*parts)).alias("x"))
    return out.select(PANEL, "x.source", "x.variance", F.when(F.col("total") > 0, F.col("x.variance") / F.col("total")).alias("share"), "reconciled")


def bounded_least_squares(design: np.ndarray, target: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 200) -> np.ndarray:
    """argmin |design x - target| in a box, by solving on the free variables and freeing those that the gradient asks for."""
    m = design.shape[1]
    gram, rhs = design.T @ design, design.T @ target
    x = np.clip(np.linalg.lstsq(design, target, rcond=None)[0], lower, upper)
    bound = np.where(x <= lower, -1, np.where(x >= upper, 1, 0))
    for _ in range(rounds):
        while (free := np.flatnonzero(bound == 0)).size:
            held = np.flatnonzero(bound)
            want = np.linalg.solve(gram[np.ix_(free, free)], rhs[free] - gram[np.ix_(free, held)] @ x[held])
            move = want - x[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(move > 0, (upper[free] - x[free]) / move, np.where(move < 0, (lower[free] - x[free]) / move, np.inf))
            step = min(1.0, float(room.min()))
            x[free] = np.clip(x[free] + step * move, lower[free], upper[free])
            if step >= 1:
                break
            hit = free[int(np.argmin(room))]
            bound[hit] = 1 if move[list(free).index(hit)] > 0 else -1
            x[hit] = upper[hit] if bound[hit] > 0 else lower[hit]
        pull = bound * (gram @ x - rhs)  # positive: leaving the bound lowers the objective
        if m == 0 or pull.max(initial=0) <= 1e-10 * max(1.0, float(np.abs(rhs).max(initial=0))):
            return x
        bound[int(np.argmax(pull))] = 0
    raise RuntimeError("the bounded fit did not settle")


def solve_hedge(physical, eigenvalues, dv01, instruments, lower, upper, most: float, ridge: float = 1e-8, max_condition: float = 1e8, least_reduction: float = 0.0, least_standalone: float = 1.0, least_before: float = 1.0) -> dict:
    """Quantities that minimise the modelled variance of dv01 + instruments' x quantities, or the reason for none (``refused``).

    The penalty is ridge x median standalone variance x |quantities|^2; bounds are cut to +-``most``.
    """
    none = {"quantities": None, "variance_before": None, "variance_after": None, "reduction": None, "condition": None, "refused": None}
    basis, values = np.stack([np.asarray(v, float) for v in physical]), np.asarray(eigenvalues, float)
    d, h = np.asarray(dv01, float), np.stack([np.asarray(v, float) for v in instruments])
    lower, upper = np.maximum(np.asarray(lower, float), -most), np.minimum(np.asarray(upper, float), most)
    if not (np.isfinite(d).all() and np.isfinite(h).all() and np.isfinite(lower).all() and np.isfinite(upper).all()):
        return none | {"refused": "values are not finite"}
    if (lower >= upper).any():
        return none | {"refused": "bounds are not ordered"}
    root = np.sqrt(values)[:, None] * basis  # root' root is the covariance
    before = float(((root @ d) ** 2).sum())
    design, target = root @ h.T, -(root @ d)
    alone = np.linalg.norm(design, axis=0)
    none |= {"variance_before": before}
    if math.sqrt(before) < least_before:
        return none | {"refused": "risk before the hedge is below the floor"}
    if (alone < least_standalone).any():
        return none | {"refused": "an instrument's own risk is below the floor"}
    if np.linalg.matrix_rank(design) < design.shape[1]:
        return none | {"refused": "instruments are redundant"}
    condition = float(np.linalg.cond(design))
    if not math.isfinite(condition) or condition > max_condition:
        return none | {"refused": "instruments are ill-conditioned", "condition": condition}
    if ridge > 0:
        size = math.sqrt(ridge * float(np.median(alone**2)))
        design, target = np.vstack([design, size * np.eye(len(h))]), np.concatenate([target, np.zeros(len(h))])
    q = bounded_least_squares(design, target, lower, upper)
    after = float(((root @ (d + h.T @ q)) ** 2).sum())
    reduction = 1 - after / before
    made = {"quantities": q.tolist(), "variance_before": before, "variance_after": after, "reduction": reduction, "condition": condition, "refused": None}
    if after > before * (1 + 1e-12) or reduction < least_reduction:
        return made | {"quantities": None, "refused": "the reduction is below the least asked for"}
    return made


def hedge(model: DataFrame, dv01: DataFrame, instruments: DataFrame, nodes: Nodes, bounds: tuple[float, float], most: float, **limits) -> DataFrame:
    """Hedge of each panel: panel, instruments (names in order), quantities, variances, reduction, condition, refused.

    ``instruments``: panel, instrument, node, dv01, every node once for each instrument.
    """
    matrix = instruments.groupBy(PANEL, "instrument").agg(F.array(*(F.max(F.when(F.col("node") == n, F.col("dv01"))) for n in nodes.names)).alias("row"))
    packed = matrix.groupBy(PANEL).agg(F.array_sort(F.collect_list(F.struct("instrument", "row"))).alias("m"))
    rows = model.join(dv01_vectors(dv01, nodes), PANEL).join(packed, PANEL)
    rows = rows.select(PANEL, "physical", "eigenvalues", "dv01", F.col("m.instrument").alias("instruments"), F.col("m.row").alias("rows"))

    def kernel(r):
        m = len(r["rows"])
        return solve_hedge(r["physical"], r["eigenvalues"], r["dv01"], r["rows"], [bounds[0]] * m, [bounds[1]] * m, most, **limits)

    return factors.per_row(rows, kernel, [PANEL, "instruments"], "quantities array<double>, variance_before double, variance_after double, reduction double, condition double, refused string")


def calibration_comparison(structural: DataFrame, recent: DataFrame, dv01: DataFrame, nodes: Nodes, k: int = 3) -> DataFrame:
    """P&L volatility under two calibrations and their ratio."""
    vol = lambda m, name: variance_table(m, dv01, nodes, k).where(F.col("source") == "Total").select(PANEL, F.sqrt("variance").alias(name))
    both = vol(structural, "structural").join(vol(recent, "recent"), PANEL)
    return both.withColumn("ratio", F.when(F.col("structural") > 0, F.col("recent") / F.col("structural")))
