"""Registered queries over the test tables: pseudo-curves whose nodes are classes of line items.

``O`` and ``F`` line items are two panels with return flags A, N, R as nodes; ``price`` is one panel of the seven line
numbers. Values are mean prices in units of 9,973 (a prime, so that means don't lie on rounding ties); doubles are
rounded at the end, so two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig, FactorConfig, ForecastConfig
from ..functions.stats import distribution_table, hac_test
from ..operators import factors, forecast, intervals, moments, panel, quality, risk, stability, tsqr
from ..schema import DATE, PANEL, POS, Nodes
from ..sources.panels import canonical_digest, read_parquet_panel

THREE = Nodes(("A", "N", "R"), (1.0, 3.0, 10.0))
SEVEN = Nodes(tuple("1234567"), (0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0))
DV01_THREE = (50_000.0, 150_000.0, 100_000.0)
DV01_SEVEN = (0.0, 25_000.0, 100_000.0, 150_000.0, 200_000.0, 150_000.0, 50_000.0)
UNIT, HALFLIFE, TRAIN, HISTORY, LEAST, VAR_WINDOW = 9_973.0, 52.0, 104, 104, 52, 104
SELECTION, CONFIRMATION, EVALUATION = 149, 52, 52
SEED = 20260825
FACTOR_DEFAULTS, FORECAST_DEFAULTS = FactorConfig(), ForecastConfig()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, without negative zeros; dates as ISO text."""

    def shown(f):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        return (F.round(c, digits) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("string").alias(f.name) if kind == "date" else c

    return df.select(*map(shown, df.schema))


def three_daily(spark: SparkSession, sf: str) -> DataFrame:
    return read_parquet_panel(spark, f"{sf}/lineitem.parquet", F.col("l_shipdate"), F.col("l_returnflag"), F.col("l_extendedprice") / UNIT, THREE.names, F.col("l_linestatus"))


def seven_daily(spark: SparkSession, sf: str) -> DataFrame:
    return read_parquet_panel(spark, f"{sf}/lineitem.parquet", F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_extendedprice") / UNIT, SEVEN.names, F.lit("price"))


def three_weekly(spark, sf) -> DataFrame:
    return panel.weekly_curve(three_daily(spark, sf), THREE.names)


def three(spark, sf) -> DataFrame:
    return panel.changes(three_weekly(spark, sf), THREE.names)


def seven(spark, sf) -> DataFrame:
    return panel.changes(panel.weekly_curve(seven_daily(spark, sf), SEVEN.names), SEVEN.names)


def three_pnl(spark, sf) -> DataFrame:
    c = three(spark, sf)
    return risk.linear_pnl(c, risk.same_for_all(c, THREE, DV01_THREE), THREE)


def three_forecasts(spark, sf) -> DataFrame:
    return forecast.simple_forecasts(three(spark, sf), THREE, TRAIN)


def mean_residuals(spark, sf) -> DataFrame:
    return intervals.residuals(three_forecasts(spark, sf).where(F.col("model") == forecast.MEAN))


def mean_hits(spark, sf) -> DataFrame:
    return intervals.hits(mean_residuals(spark, sf), HISTORY, LEAST)


def walk(spark, sf) -> DataFrame:
    return forecast.walk_forward(seven(spark, sf), SEVEN, TRAIN).persist()  # the gate and what follows it read it again


def gate(spark, sf) -> DataFrame:
    return forecast.adoption_gate(walk(spark, sf), EVALUATION, CONFIRMATION)


# ---- queries with SQL -------------------------------------------------------------------------


def panel_daily(spark, sf):
    return rounded(three_daily(spark, sf))


def weekly_curve(spark, sf):
    return rounded(three_weekly(spark, sf))


def weekly_curve_drop(spark, sf):
    return rounded(panel.weekly_curve(three_daily(spark, sf).where(F.col(DATE).between("1996-01-03", "2000-06-28")), THREE.names, "WED", "drop", "1996-01-03", "2000-06-28"))


def weekly_changes(spark, sf):
    return rounded(three(spark, sf))


def gap_histogram(spark, sf):
    return panel.gap_histogram(three(spark, sf))


def change_validity(spark, sf):
    v = panel.validate_changes(three(spark, sf), THREE.names)
    return v.select(PANEL, "n_rows", "n_not_finite", F.size("constant_nodes").alias("n_constant"), "valid")


def quality_figures(spark, sf):
    daily, weekly = three_daily(spark, sf), three_weekly(spark, sf)
    m = quality.quality_metrics(daily, weekly, panel.changes(weekly, THREE.names), THREE, THREE.names, policy="include_and_flag")
    return rounded(m.select(PANEL, "n_days", "duplicate_days", "min_value", "max_value", "n_weeks", "n_changes", "max_gap", "min_gap", "not_seven", "max_jump", "start_lag", "end_lag"))


def covariance(spark, sf):
    return rounded(moments.covariance_table(moments.moments(three(spark, sf), THREE.names), THREE.names), 4)


def covariance_recent(spark, sf):
    return rounded(moments.covariance_table(moments.moments(three(spark, sf), THREE.names, weight=moments.ewma_weight(HALFLIFE)), THREE.names), 4)


def eigenvalues(spark, sf):
    m = factors.fit(three(spark, sf), THREE)
    return rounded(factors.component_table(m).select(PANEL, "component", "eigenvalue", "share", "cumulative_share"), 4)


def eigen_trace(spark, sf):
    m = factors.fit(seven(spark, sf), SEVEN)
    add = lambda f: F.aggregate("eigenvalues", F.lit(0.0), f)
    return rounded(m.select(PANEL, "n_obs", add(lambda s, v: s + v).alias("trace"), F.sqrt(add(lambda s, v: s + v * v)).alias("frobenius")), 4)


def first_projector(spark, sf):
    m = factors.fit(three(spark, sf), THREE)
    v = F.col("components")[0]
    cells = [F.struct(F.lit(a).alias("node_i"), F.lit(b).alias("node_j"), (v[i] * v[j]).alias("weight")) for i, a in enumerate(THREE.names) for j, b in enumerate(THREE.names)]
    return rounded(m.select(PANEL, F.explode(F.array(*cells)).alias("x")).select(PANEL, "x.*"))


def first_reconstruction(spark, sf):
    c = three(spark, sf)
    return rounded(factors.error_metrics(factors.reconstruct(c, factors.fit(c, THREE), THREE, 1)), 5)


def pnl(spark, sf):
    return rounded(three_pnl(spark, sf).select(PANEL, DATE, POS, "pnl"), 2)


def pnl_attribution(spark, sf):
    c = three(spark, sf)
    rows = risk.factor_pnl(c, risk.same_for_all(c, THREE, DV01_THREE), factors.fit(c, THREE), THREE, 1)
    return rounded(rows.withColumn("source", F.when(F.col("source").startswith("PC1"), "First factor").otherwise(F.col("source"))), 1)


def variance_sources(spark, sf):
    c = three(spark, sf)
    v = risk.variance_table(factors.fit(c, THREE), risk.same_for_all(c, THREE, DV01_THREE), THREE, 1)
    share = F.col("variance") / F.lit(1e12)
    return rounded(v.select(PANEL, F.when(F.col("source").startswith("PC1"), "First factor").otherwise(F.col("source")).alias("source"), share.alias("variance_millions"), "share", "reconciled"), 4)


def worst_scenarios(spark, sf):
    c = three(spark, sf)
    return rounded(risk.worst_scenarios(c, risk.same_for_all(c, THREE, DV01_THREE), THREE, 10), 2)


def tail_summary(spark, sf):
    p = three_pnl(spark, sf)
    both = risk.tail_summary(p, VAR_WINDOW).unionByName(risk.tail_summary(p, None))
    return rounded(both.withColumn("rank", F.col("rank").cast("double")).withColumn("attainable", F.col("attainable").cast("string")), 2)


def var_backtest(spark, sf):
    return rounded(risk.backtest_detail(three_pnl(spark, sf), VAR_WINDOW), 2)


def var_backtest_tests(spark, sf):
    s = risk.backtest_summary(risk.backtest_detail(three_pnl(spark, sf), VAR_WINDOW), VAR_WINDOW, least_rows=100)
    return rounded(s.select(PANEL, "n", "exceptions", "expected", "rate", "kupiec_lr", "independence_lr", "joint_lr", "joint_p"))


def mean_forecast(spark, sf):
    return rounded(three_forecasts(spark, sf))


def forecast_metrics(spark, sf):
    return rounded(forecast.forecast_metrics(three_forecasts(spark, sf)))


def clark_west(spark, sf):
    a = forecast.loss_advantages(three_forecasts(spark, sf)).where(F.col("model") == forecast.MEAN)
    return rounded(hac_test(a, [PANEL, "model"], POS, "adjusted", 4).select(PANEL, "model", "n", "mean", "statistic"), 4)


def node_ar1(spark, sf):
    return rounded(forecast.node_ar1(three(spark, sf), THREE, TRAIN), 5)


def interval_hits(spark, sf):
    return rounded(mean_hits(spark, sf).select(PANEL, DATE, "node", "coverage", "lower", "upper", "hit"), 5)


def interval_coverage(spark, sf):
    return rounded(intervals.coverage_counts(mean_hits(spark, sf)).drop("wilson_low", "wilson_high"))


def joint_hits(spark, sf):
    return rounded(intervals.joint_hits(mean_hits(spark, sf)))


def distribution(spark, sf):
    d = distribution_table(panel.long_form(three(spark, sf), THREE.names), [PANEL, "node"], POS, "value")
    return rounded(d.select(PANEL, "node", "n", "skewness", "excess_kurtosis", "jarque_bera", "ljung_box", "ljung_box_p", "ljung_box_squares"), 4)


def content_digest(spark, sf):
    c = three(spark, sf)
    whole = c.select(PANEL, DATE, *(F.round(n, 3).alias(n) for n in THREE.names))
    return canonical_digest(whole, THREE)


def event_gaps(spark, sf):
    """Seconds of each user between events: count, mean and largest gap."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    g = e.withColumn("gap", gap).where("gap is not null")
    return rounded(g.groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")), 3)


# ---- queries of numeric kernels (tested against brute force) ------------------------------------


def factor_loadings(spark, sf):
    return rounded(factors.loading_table(factors.fit(seven(spark, sf), SEVEN), SEVEN, 3))


def specifications(spark, sf):
    return rounded(stability.specifications(seven(spark, sf), SEVEN, HALFLIFE))


def rolling_stability(spark, sf):
    c = seven(spark, sf)
    return rounded(stability.rolling(c, factors.fit(c, SEVEN), SEVEN, 104).select(PANEL, "window_end", "first_date", "last_date", "n_obs", "top_share", "max_angle", "projection_distance", "cutoff_gap", "min_similarity", *(F.col("cosines")[j].alias(f"cosine_{j + 1}") for j in range(3))))


def sequential_stability(spark, sf):
    return rounded(stability.sequential(seven(spark, sf), SEVEN, 104).select(PANEL, "window_end", "r_first_date", "r_last_date", "c_first_date", "c_last_date", "top_share", "max_angle", "min_cosine"))


def bootstrap_stability(spark, sf):
    c = seven(spark, sf)
    return rounded(stability.bootstrap_summary(stability.bootstrap(c, factors.fit(c, SEVEN), SEVEN, FACTOR_DEFAULTS.bootstrap_replications, (13,), seed=SEED), 3, SEED))


def block_sensitivity(spark, sf):
    c = seven(spark, sf)
    return rounded(stability.block_sensitivity(stability.bootstrap_summary(stability.bootstrap(c, factors.fit(c, SEVEN), SEVEN, FACTOR_DEFAULTS.bootstrap_sensitivity_replications, (4, 13, 26), seed=SEED), 3, SEED)))


def oos_reconstruction(spark, sf):
    return rounded(factors.error_metrics(stability.oos_reconstruction(seven(spark, sf), SEVEN, TRAIN)))


def method_regimes(spark, sf):
    return rounded(stability.regimes(seven(spark, sf), SEVEN, "1998-06-01", least_rows=52))


def recency_comparison(spark, sf):
    c = seven(spark, sf)
    return rounded(factors.regime_table(factors.compare_models(factors.fit(c, SEVEN), factors.fit(c, SEVEN, halflife=HALFLIFE), 3)))


def algebra_checks(spark, sf):
    c = seven(spark, sf)
    return quality.algebra_checks(c, factors.fit(c, SEVEN), moments.moments(c, SEVEN.names), SEVEN).select(PANEL, "control", "threshold", "status")


def walk_forward_metrics(spark, sf):
    return rounded(forecast.forecast_metrics(walk(spark, sf)))


def adoption_gate(spark, sf):
    return rounded(gate(spark, sf))


def interval_evidence(spark, sf):
    p = walk(spark, sf)
    g = forecast.adoption_gate(p, EVALUATION, CONFIRMATION)
    return rounded(intervals.coverage(intervals.selected_residuals(p, g), SEVEN, HISTORY, LEAST, SELECTION + CONFIRMATION, replications=FORECAST_DEFAULTS.interval_bootstrap_replications))


def latest_bands(spark, sf):
    weekly = panel.weekly_curve(seven_daily(spark, sf), SEVEN.names)
    c = panel.changes(weekly, SEVEN.names)
    p = forecast.walk_forward(c, SEVEN, TRAIN).persist()
    g = forecast.adoption_gate(p, EVALUATION, CONFIRMATION)
    return rounded(intervals.latest_bands(intervals.selected_residuals(p, g), forecast.latest_forecast(weekly, c, g, SEVEN), HISTORY))


def factor_scenarios(spark, sf):
    c = seven(spark, sf)
    return rounded(risk.factor_scenarios(factors.fit(c, SEVEN), risk.same_for_all(c, SEVEN, DV01_SEVEN), SEVEN), 4)


def hedge(spark, sf):
    c = seven(spark, sf)
    names = ("h2", "h5", "h10")
    rows = [("price", n, node, 1_000.0 if node == at else 0.0) for n, at in zip(names, ("3", "5", "7"), strict=True) for node in SEVEN.names]
    instruments = spark.createDataFrame(rows, "panel string, instrument string, node string, dv01 double")
    return rounded(risk.hedge(factors.fit(c, SEVEN), risk.same_for_all(c, SEVEN, DV01_SEVEN), instruments, SEVEN, (-150.0, 150.0), 150.0).select(PANEL, "instruments", F.transform("quantities", lambda q: F.round(q, 4)).alias("quantities"), "reduction", "refused"))


def calibration(spark, sf):
    c = seven(spark, sf)
    return rounded(risk.calibration_comparison(factors.fit(c, SEVEN), factors.fit(c, SEVEN, halflife=HALFLIFE), risk.same_for_all(c, SEVEN, DV01_SEVEN), SEVEN))


def quality_checks(spark, sf):
    daily, weekly = three_daily(spark, sf), three_weekly(spark, sf)
    settings = DataConfig(start_date="1995-01-01", end_date="2001-11-30", boundary_week_policy="include_and_flag", minimum_complete_weeks=52)
    m = quality.quality_metrics(daily, weekly, panel.changes(weekly, THREE.names), THREE, THREE.names, policy="include_and_flag", start=settings.start_date, end=settings.end_date)
    return rounded(quality.quality_checks(m, settings, as_of="2001-12-01", regime_change="1998-06-01"), 4)


def model_health(spark, sf):
    c = seven(spark, sf)
    model = factors.fit(c, SEVEN)
    return rounded(quality.health_table(stability.rolling(c, model, SEVEN, 104), factors.error_metrics(stability.oos_reconstruction(c, SEVEN, TRAIN)), stability.sequential(c, SEVEN, 104)))


def overall_assessment(spark, sf):
    return quality.assessment(model_health(spark, sf), algebra_checks(spark, sf))


# ---- kernels on curves of three nodes, whose eigenvalues SQL has in closed form ----------------


def shown_comparison(df: DataFrame, *keys) -> DataFrame:
    """Figures of a comparison of first factors, to the places that both routes agree on."""
    return rounded(df.select(PANEL, *keys, F.col("top_share").alias("share"), F.col("cosines")[0].alias("cosine"), F.col("max_angle").alias("angle")), 3)


def first_factor_rolling(spark, sf):
    c = three(spark, sf)
    return shown_comparison(stability.rolling(c, factors.fit(c, THREE), THREE, 104, k=1), "window_end", "first_date", "last_date", "n_obs")


def first_factor_sequential(spark, sf):
    return shown_comparison(stability.sequential(three(spark, sf), THREE, 104, k=1), "window_end")


def first_factor_oos(spark, sf):
    return rounded(factors.error_metrics(stability.oos_reconstruction(three(spark, sf), THREE, TRAIN, k=1)), 4)


def first_factor_regimes(spark, sf):
    t = stability.regimes(three(spark, sf), THREE, "1998-06-01", k=1, least_rows=52)
    return rounded(t.select(PANEL, "n_before", "n_after", "status", "cosine", F.col("principal_angle").alias("angle"), "sigma_ratio"), 3)


def first_factor_recency(spark, sf):
    c = three(spark, sf)
    t = factors.regime_table(factors.compare_models(factors.fit(c, THREE), factors.fit(c, THREE, halflife=HALFLIFE), 1))
    return rounded(t.select(PANEL, "cosine", F.col("principal_angle").alias("angle"), "reference_sigma", "candidate_sigma", "sigma_ratio"), 3)


def first_factor_scenarios(spark, sf):
    """Sizes of the P&L of one, two and three deviations of the first factor (its sign is a matter of convention)."""
    c = three(spark, sf)
    t = risk.factor_scenarios(factors.fit(c, THREE), risk.same_for_all(c, THREE, DV01_THREE), THREE, 1)
    return rounded(t.groupBy(PANEL, F.abs("multiple").alias("multiple")).agg(F.max("pnl").alias("gain"), F.min("pnl").alias("loss"), F.count("*").alias("n")), 1)


def specification_shares(spark, sf):
    t = stability.specifications(three(spark, sf), THREE, HALFLIFE, 1)
    return rounded(t.select(PANEL, "specification", "first_date", "last_date", "n_obs", "n_eff", "share_1", "share_2", "share_3", "top_share"), 4)


def calibration_three(spark, sf):
    c = three(spark, sf)
    return rounded(risk.calibration_comparison(factors.fit(c, THREE), factors.fit(c, THREE, halflife=HALFLIFE), risk.same_for_all(c, THREE, DV01_THREE), THREE, 1), 1)


def walk_forward_baselines(spark, sf):
    """Metrics of the models that need no factors, out of the whole walk."""
    return rounded(forecast.forecast_metrics(forecast.walk_forward(seven(spark, sf), SEVEN, TRAIN).where(F.col("model").isin(forecast.NO_CHANGE, forecast.MEAN))), 5)


def gate_evidence(spark, sf):
    """Evidence of the historical mean against no change, by partition."""
    g = forecast.adoption_gate(three_forecasts(spark, sf), EVALUATION, CONFIRMATION).where(F.col("model") == forecast.MEAN)
    sides = [g.select(PANEL, F.lit(side).alias("partition"), *(F.col(f"{side.lower()}_{c}").alias(c) for c in ("rows", "first_date", "last_date", "rmse", "improvement", "advantage", "hac", "cw_advantage", "cw"))) for side in ("Selection", "Confirmation")]
    return rounded(sides[0].unionByName(sides[1]), 4)


def _health_three(spark, sf):
    c = three(spark, sf)
    return quality.health_table(stability.rolling(c, factors.fit(c, THREE), THREE, 104, k=1), factors.error_metrics(stability.oos_reconstruction(c, THREE, TRAIN, k=1)), stability.sequential(c, THREE, 104, k=1))


def first_factor_health(spark, sf):
    return rounded(_health_three(spark, sf), 3)


def first_factor_assessment(spark, sf):
    return quality.assessment(_health_three(spark, sf), quality_checks(spark, sf).where(F.col("measured_on") != "source"))


# ---- whole models of three nodes, by projectors --------------------------------------------------


def spectrum_by_qr(spark, sf):
    """Eigenvalues of the weekly changes by the QR tree, which forms no covariance."""
    return rounded(tsqr.spectrum_table(tsqr.spectrum(three(spark, sf), THREE.names)), 4)


def two_factor_rolling(spark, sf):
    c = three(spark, sf)
    t = stability.rolling(c, factors.fit(c, THREE), THREE, 104, k=2)
    pick = [F.col(name)[j].alias(f"{short}_{j + 1}") for name, short in (("cosines", "cosine"), ("matched", "matched")) for j in range(2)]
    return rounded(t.select(PANEL, "window_end", F.col("top_share").alias("share"), F.col("max_angle").alias("angle"), *pick), 3)


def template_match(spark, sf):
    return rounded(factors.component_table(factors.fit(three(spark, sf), THREE)).select(PANEL, "component", "label", "suggested_shape", "identified", "similarity", "margin"), 3)


def factor_ar1(spark, sf):
    """Errors of the factor AR(1) walk with all three factors, by node."""
    made = forecast.walk_forward(three(spark, sf), THREE, TRAIN).where(F.col("model") == forecast.AR)
    e = F.col("fitted") - F.col("actual")
    return rounded(made.groupBy(PANEL, "node").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg("fitted").alias("mean_forecast")), 4)


def latest_mean_bands(spark, sf):
    """Bands of the next level around the historical mean."""
    weekly = three_weekly(spark, sf)
    c = panel.changes(weekly, THREE.names)
    chosen = c.select(PANEL).distinct().withColumns({"model": F.lit(forecast.MEAN), "selected": F.lit(True)})
    return rounded(intervals.latest_bands(mean_residuals(spark, sf), forecast.latest_forecast(weekly, c, chosen, THREE), HISTORY), 5)


WITH_SQL = (panel_daily, weekly_curve, weekly_curve_drop, weekly_changes, gap_histogram, change_validity, quality_figures, covariance, covariance_recent, eigenvalues, eigen_trace, first_projector, first_reconstruction, pnl, pnl_attribution, variance_sources, worst_scenarios, tail_summary, var_backtest, var_backtest_tests, mean_forecast, forecast_metrics, clark_west, node_ar1, interval_hits, interval_coverage, joint_hits, distribution, content_digest, event_gaps, quality_checks, first_factor_rolling, first_factor_sequential, first_factor_oos, first_factor_regimes, first_factor_recency, first_factor_scenarios, specification_shares, calibration_three, walk_forward_baselines, gate_evidence, first_factor_health, first_factor_assessment, spectrum_by_qr, two_factor_rolling, template_match, factor_ar1, latest_mean_bands)
KERNELS = (factor_loadings, specifications, rolling_stability, sequential_stability, bootstrap_stability, block_sensitivity, oos_reconstruction, method_regimes, recency_comparison, algebra_checks, walk_forward_metrics, adoption_gate, interval_evidence, latest_bands, factor_scenarios, hedge, calibration, model_health, overall_assessment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in WITH_SQL + KERNELS}
