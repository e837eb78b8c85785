"""The public interface: six verbs over curves, and what they return.

Results hold lazy tables (DataFrames with a ``panel`` column), so one call serves one curve or very many.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AnalysisConfig as PipelineConfig
from .config import DataConfig, ForecastConfig, RiskConfig
from .config import FactorConfig as PCAConfig
from .operators import factors, forecast, intervals, panel, quality, risk
from .plans import run
from .schema import TREASURY, TREASURY_CORE, Nodes
from .sources import panels
from .sources.panels import Provenance as DataProvenance

ALL_TENORS, CORE_TENORS = TREASURY.names, TREASURY_CORE.names
FRED_SERIES = dict(zip(TREASURY.series_ids, TREASURY.names, strict=True))
MATURITY_YEARS = dict(zip(TREASURY.names, TREASURY.maturities, strict=True))
__all__ = ["ALL_TENORS", "CORE_TENORS", "FRED_SERIES", "MATURITY_YEARS", "DataConfig", "ForecastConfig", "PCAConfig", "PipelineConfig", "RiskConfig", "DataProvenance"]


@dataclass
class CurveDataBundle:
    """Daily curves of all nodes, whole weekly curves and changes of the analysed ones, quality controls, and where they come from."""

    daily: DataFrame
    weekly: DataFrame
    changes: DataFrame
    quality: DataFrame
    provenance: DataProvenance
    nodes: Nodes


@dataclass
class PCAFit:
    """Factor models, a row for each panel."""

    model: DataFrame
    changes: DataFrame
    nodes: Nodes
    standardize: bool = False
    halflife: float | None = None

    @property
    def score_unit(self) -> str:
        return factors.score_unit(self.standardize)

    def components(self, k: int | None = None) -> DataFrame:
        return factors.component_table(self.model, k)

    def loadings(self, k: int = 3) -> DataFrame:
        return factors.loading_table(self.model, self.nodes, k)

    def component_of(self, shape: str) -> DataFrame:
        return factors.component_of(self.model, shape)

    def transform(self, changes: DataFrame | None = None) -> DataFrame:
        return factors.transform(self.changes if changes is None else changes, self.model, self.nodes)

    def reconstruct(self, k: int = 3, changes: DataFrame | None = None) -> DataFrame:
        return factors.reconstruct(self.changes if changes is None else changes, self.model, self.nodes, k)


@dataclass
class ForecastResult:
    """Walk-forward predictions, their metrics, the gate's evidence, and the selected model's next curve with bands."""

    predictions: DataFrame
    metrics: DataFrame
    gate: DataFrame
    latest: DataFrame
    bands: DataFrame
    coverage: DataFrame
    joint_hits: DataFrame


@dataclass
class RiskMappingResult:
    """P&L by source, tail measures, back-test, scenarios and variances of a portfolio."""

    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class HedgeResult:
    """Quantities of each panel's instruments, or why there are none."""

    table: DataFrame


@dataclass
class ValidationSummary:
    """Quality, algebra and health controls, and what they add up to for each panel."""

    quality: DataFrame
    algebra: DataFrame
    health: DataFrame
    assessment: DataFrame


@dataclass
class PipelineResult:
    """All tables of an analysis by name, notes on absent ones, and the validation."""

    tables: dict[str, DataFrame]
    notes: dict[str, str]
    validation: ValidationSummary


def load_curve_data(spark: SparkSession, config: DataConfig, snapshot: tuple[str, str] | None = None, csv: str | None = None, fetch=None, cache: str = "cache", as_of: str | None = None, nodes: Nodes = TREASURY) -> CurveDataBundle:
    """Curves of the configured source (a CSV file, a snapshot with its manifest, or a live source), with quality controls; raises if one fails."""
    if csv:
        daily, mode = panels.read_csv_panel(spark, csv, nodes, config), "SNAPSHOT"
        n, first, last = daily.agg(F.count("*"), F.min("date"), F.max("date")).first()
        proof = DataProvenance(mode, csv, panels.file_digest(spark, csv)[1], "", n, str(first), str(last))
    else:
        daily, proof = panels.read_source(spark, config, nodes, snapshot, fetch or panels.http_fetch(config.maximum_response_bytes), cache)
    core = nodes.subset(config.core_tenors)
    weekly = panel.weekly_curve(daily, core.names, config.anchor, config.boundary_week_policy, config.start_date, config.end_date)
    changes = panel.changes(weekly, core.names)
    metrics = quality.quality_metrics(daily, weekly, changes, nodes, core.names, config.anchor, config.boundary_week_policy, config.start_date, config.end_date)
    checks = quality.quality_checks(metrics, config, proof.mode, as_of or proof.last_date, run.METHOD_CHANGE)
    quality.refuse_failures(checks)
    return CurveDataBundle(daily, weekly, changes, checks, proof, core)


def fit_curve_pca(changes: DataFrame, nodes: Nodes, config: PCAConfig | None = None, standardize: bool = False, halflife: float | None = None) -> PCAFit:
    """Factor models of weekly changes: covariance, correlation or recency-weighted."""
    c = config or PCAConfig()
    model = factors.fit(changes, nodes, standardize, halflife, least_similarity=c.minimum_template_similarity, least_margin=c.minimum_template_dominance_margin)
    return PCAFit(model, changes, nodes, standardize, halflife)


def walk_forward_forecast(weekly: DataFrame, changes: DataFrame, nodes: Nodes, config: ForecastConfig | None = None) -> ForecastResult:
    """Forecasts from every origin, the gate, and bands; raises if the inputs can't be walked through."""
    c = config or ForecastConfig()
    forecast.check_inputs(changes, nodes, c.minimum_training_weeks, weekly, c.level_change_reconciliation_tolerance_bp)
    made = forecast.walk_forward(changes, nodes, c.minimum_training_weeks, c.retained_factors, c.ar_coefficient_bound, c.var_ridge)
    gate = forecast.adoption_gate(made, c.interval_evaluation_observations, c.confirmation_observations, c.adoption_alpha, c.minimum_rmse_improvement, c.hac_lags)
    rows = intervals.selected_residuals(made, gate)
    latest = forecast.latest_forecast(weekly, changes, gate, nodes, c.retained_factors, c.ar_coefficient_bound, c.var_ridge)
    coverage = intervals.coverage(rows, nodes, c.interval_history_weeks, c.minimum_interval_observations, None, c.interval_coverage_tolerance, c.interval_validation_alpha, c.interval_bootstrap_block_lengths, c.interval_bootstrap_replications, c.interval_bootstrap_random_seed)
    hits = intervals.hits(rows, c.interval_history_weeks, c.minimum_interval_observations)
    return ForecastResult(made, forecast.forecast_metrics(made), gate, latest, intervals.latest_bands(rows, latest, c.interval_history_weeks), coverage, intervals.joint_hits(hits))


def map_linear_curve_risk(changes: DataFrame, dv01: DataFrame, fit: PCAFit, config: RiskConfig | None = None, k: int = 3) -> RiskMappingResult:
    """First-order risk of sensitivities (panel, node, dv01); raises if they don't fit the nodes."""
    c, nodes = config or RiskConfig(), fit.nodes
    if not 1 <= k <= len(nodes.names) or isinstance(k, bool):
        raise ValueError("k must lie between one and the number of nodes")
    if wrong := risk.dv01_defects(dv01, changes, nodes).limit(3).collect():
        raise ValueError("sensitivities: " + "; ".join(f"{x.panel} {x.node} {x.defect}" for x in wrong))
    pnl = risk.linear_pnl(changes, dv01, nodes)
    detail = risk.backtest_detail(pnl, c.historical_window_weeks, c.var_confidence)
    tails = [risk.tail_summary(pnl, n, c.var_confidence, c.es_confidence, c.minimum_effective_tail_mass_review) for n in (c.historical_window_weeks, None)]
    return RiskMappingResult(
        {
            "pnl": risk.factor_pnl(changes, dv01, fit.model, nodes, k), "tails": tails[0].unionByName(tails[1]), "backtest_detail": detail,
            "backtest": risk.backtest_summary(detail, c.historical_window_weeks, c.var_confidence, c.backtest_alpha, c.minimum_var_backtest_observations),
            "worst_scenarios": risk.worst_scenarios(changes, dv01, nodes), "factor_scenarios": risk.factor_scenarios(fit.model, dv01, nodes, k, c.factor_sigma_multiples), "variance": risk.variance_table(fit.model, dv01, nodes, k),
        }
    )


def optimize_key_rate_hedge(fit: PCAFit, dv01: DataFrame, instruments: DataFrame, bounds: tuple[float, float], **limits) -> HedgeResult:
    """Quantities within ``bounds`` that minimise the modelled variance of each panel's portfolio."""
    return HedgeResult(risk.hedge(fit.model, dv01, instruments, fit.nodes, bounds, max(abs(x) for x in bounds), **limits))


def run_pipeline(daily: DataFrame, nodes: Nodes, config: PipelineConfig | None = None, mode: str = "SNAPSHOT", as_of: str | None = None, dv01: DataFrame | None = None, universe: Nodes | None = None, forecasts: bool = True) -> PipelineResult:
    """The whole analysis of daily curves."""
    made = run.analyse(daily, nodes, config or PipelineConfig(), mode, as_of, dv01, universe=universe, forecasts=forecasts)
    t = made.tables
    return PipelineResult(t, made.notes, ValidationSummary(t["quality_checks"], t["algebra"], t["health"], made.assessment))
