"""Settings with their allowed ranges. Every setting is checked when it is made; booleans are no numbers."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields
from datetime import date
from pathlib import Path

from .operators.panel import WEEKDAYS
from .schema import TREASURY, TREASURY_CORE

INF = math.inf
SOURCE_MODES = ("snapshot", "live", "live_then_snapshot")
POLICIES = ("drop", "include_and_flag")
WEEKLY_RULES = tuple(f"W-{day}" for day in WEEKDAYS)
#: Days that a live curve may lag where neither its end nor a limit is told.
LIVE_STALENESS_DAYS = 7

# Names of sections and settings, defaults and ranges are fixed values: configuration files in use must load.


def between(default, low, high, open_low: bool = False, open_high: bool = False, whole: bool = False, optional: bool = False):
    """A number in a range."""
    return field(default=default, metadata={"low": low, "high": high, "open_low": open_low, "open_high": open_high, "whole": whole, "optional": optional})


def _check(name: str, value, m) -> None:
    if value is None and m["optional"]:
        return
    if isinstance(value, bool) or not isinstance(value, int if m["whole"] else (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite {'integer' if m['whole'] else 'number'}")
    if value < m["low"] or value > m["high"] or (m["open_low"] and value == m["low"]) or (m["open_high"] and value == m["high"]):
        raise ValueError(f"{name}={value} is outside its range")


class Checked:
    def __post_init__(self):
        for f in fields(self):
            if "low" in f.metadata:
                _check(f.name, getattr(self, f.name), f.metadata)
            elif isinstance(f.default, bool) and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name} must be true or false")
        self.relations()

    def relations(self) -> None:
        """Constraints between settings."""

    def blocks(self, name: str, low: int, high: int) -> None:
        v = getattr(self, name)
        if not isinstance(v, tuple) or not v or len(set(v)) != len(v) or any(isinstance(x, bool) or not isinstance(x, int) or not low <= x <= high for x in v):
            raise ValueError(f"{name} must be a tuple of distinct whole numbers in {low}..{high}")


@dataclass(frozen=True)
class DataConfig(Checked):
    start_date: str = "2000-01-01"
    end_date: str = "2025-12-31"
    source_mode: str = "snapshot"
    weekly_rule: str = "W-FRI"
    boundary_week_policy: str = "drop"
    core_tenors: tuple[str, ...] = TREASURY_CORE.names
    snapshot_path: str = "data/h15_treasury_cmt_2000_2025.csv.gz"
    manifest_path: str = "data/source_manifest.json"
    cache_dir: str = ".cache/yield_curve_pca"
    use_cache: bool = True
    cache_max_age_hours: float = between(24, 0, 8760, open_low=True)
    request_timeout_seconds: float = between(10, 0, 120, open_low=True)
    retries: int = between(2, 1, 10, whole=True)
    maximum_response_bytes: int = between(25_000_000, 1_000, 250_000_000, whole=True)
    minimum_complete_weeks: int = between(260, 52, 10_000, whole=True)
    maximum_start_coverage_gap_days: int = between(7, 0, 366, whole=True)
    maximum_end_coverage_gap_days: int = between(7, 0, 366, whole=True)
    maximum_within_week_observation_lag_days: int = between(1, 0, 366, whole=True)
    maximum_calendar_gap_days: int = between(12, 7, 366, whole=True)
    maximum_staleness_days: int | None = between(None, 0, 36_600, whole=True, optional=True)

    def relations(self):
        if date.fromisoformat(self.start_date) >= date.fromisoformat(self.end_date):
            raise ValueError("start_date must lie before end_date")
        for name, known in (("source_mode", SOURCE_MODES), ("weekly_rule", WEEKLY_RULES), ("boundary_week_policy", POLICIES)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")
        core = self.core_tenors
        if not isinstance(core, tuple) or len(set(core)) != len(core) or len(core) < 3 or not set(core) <= set(TREASURY.names):
            raise ValueError("core_tenors must be a tuple of three or more distinct known nodes")
        for name in ("snapshot_path", "manifest_path", "cache_dir"):
            if not isinstance(getattr(self, name), str) or not getattr(self, name):
                raise ValueError(f"{name} must be a path")

    @property
    def anchor(self) -> str:
        """Weekday that a week ends on."""
        return self.weekly_rule.removeprefix("W-")


@dataclass(frozen=True)
class FactorConfig(Checked):
    retained_factors: int = between(3, 1, 3, whole=True)
    minimum_template_similarity: float = between(0.70, 0, 1, open_low=True)
    minimum_template_dominance_margin: float = between(0.10, 0, 1, open_high=True)
    current_halflife_weeks: float = between(52, 1, INF, open_low=True)
    minimum_ewma_effective_observations: float = between(100, 20, INF)
    rolling_window_years: int = between(5, 2, 30, whole=True)
    minimum_rolling_observations: int = between(200, 52, 1560, whole=True)
    maximum_principal_angle_warning_degrees: float = between(30, 0, 90, open_low=True)
    minimum_loading_cosine_warning: float = between(0.80, 0, 1)
    maximum_oos_rmse_warning_bp: float = between(5, 0, INF, open_low=True)
    minimum_methodology_regime_observations: int = between(104, 52, 100_000, whole=True)
    maximum_methodology_subspace_angle_warning_degrees: float = between(15, 0, 90, open_low=True)
    maximum_methodology_sigma_ratio_warning: float = between(1.25, 1, INF, open_low=True)
    maximum_current_factor_sigma_ratio_warning: float = between(1.25, 1, INF, open_low=True)
    bootstrap_replications: int = between(2000, 800, 100_000, whole=True)
    bootstrap_block_weeks: int = between(13, 2, 5200, whole=True)
    bootstrap_sensitivity_replications: int = between(2000, 800, 20_000, whole=True)
    bootstrap_sensitivity_blocks: tuple[int, ...] = (4, 13, 26)
    oos_minimum_training_observations: int = between(520, 104, 10_000, whole=True)
    oos_minimum_holdout_observations: int = between(104, 52, 5200, whole=True)
    oos_refit_every_observations: int = between(13, 1, 520, whole=True)
    random_seed: int = between(20260825, -INF, INF, whole=True)

    def relations(self):
        self.blocks("bootstrap_sensitivity_blocks", 2, 5200)
        if len(self.bootstrap_sensitivity_blocks) > 20:
            raise ValueError("at most 20 block lengths")
        if self.minimum_rolling_observations > 52 * self.rolling_window_years:
            raise ValueError("minimum_rolling_observations must fit the rolling window")


@dataclass(frozen=True)
class ForecastConfig(Checked):
    enabled: bool = True
    minimum_training_weeks: int = between(520, 104, 10_000, whole=True)
    retained_factors: int = between(3, 1, 3, whole=True)
    var_ridge: float = between(1e-3, 0, INF)
    ar_coefficient_bound: float = between(0.995, 0, 1, open_low=True, open_high=True)
    hac_lags: int = between(4, 0, 52, whole=True)
    interval_history_weeks: int = between(260, 20, 5200, whole=True)
    minimum_interval_observations: int = between(104, 20, 5200, whole=True)
    minimum_model_selection_observations: int = between(52, 20, 5200, whole=True)
    confirmation_observations: int = between(52, 20, 5200, whole=True)
    interval_evaluation_observations: int = between(260, 20, 5200, whole=True)
    interval_coverage_tolerance: float = between(0.03, 0, 0.20, open_high=True)
    interval_validation_alpha: float = between(0.05, 0, 0.5, open_low=True, open_high=True)
    interval_bootstrap_replications: int = between(20_000, 500, 200_000, whole=True)
    interval_bootstrap_block_lengths: tuple[int, ...] = (4, 13, 26)
    interval_bootstrap_random_seed: int = between(17_729, -INF, INF, whole=True)
    level_change_reconciliation_tolerance_bp: float = between(1e-8, 0, 1e-3, open_low=True)
    adoption_alpha: float = between(0.05, 0, 1, open_low=True, open_high=True)
    minimum_rmse_improvement: float = between(0.01, 0, 1, open_high=True)

    def relations(self):
        self.blocks("interval_bootstrap_block_lengths", 2, 520)
        if self.minimum_interval_observations > self.interval_history_weeks:
            raise ValueError("minimum_interval_observations must fit the interval history")
        if self.interval_bootstrap_replications * self.interval_validation_alpha / (2 * 22) < 20:
            raise ValueError("the interval bootstrap leaves under 20 order statistics in a tail")
        if self.interval_evaluation_observations < 2 * max(self.interval_bootstrap_block_lengths):
            raise ValueError("the evaluation window must hold the longest block twice")
        if min(self.minimum_model_selection_observations, self.confirmation_observations) < 2 * self.hac_lags + 2:
            raise ValueError("test partitions are too short for the lags")

    @property
    def holdout(self) -> int:
        """Rows that must be forecast: selection and confirmation (or the least interval history), then evaluation."""
        return max(self.minimum_model_selection_observations + self.confirmation_observations, self.minimum_interval_observations) + self.interval_evaluation_observations

    @property
    def required_rows(self) -> int:
        return self.minimum_training_weeks + self.holdout


@dataclass(frozen=True)
class RiskConfig(Checked):
    historical_window_weeks: int = between(520, 104, 10_000, whole=True)
    var_confidence: float = between(0.99, 0.5, 1, open_low=True, open_high=True)
    es_confidence: float = between(0.975, 0.5, 1, open_low=True, open_high=True)
    backtest_alpha: float = between(0.05, 0, 0.5, open_low=True, open_high=True)
    minimum_var_backtest_observations: int = between(250, 100, 10_000, whole=True)
    maximum_krd_asof_gap_days: int = between(7, 0, 366, whole=True)
    minimum_effective_tail_mass_review: float = between(20, 1, 10_000)
    factor_sigma_multiples: tuple[float, ...] = (1.0, 2.0, 3.0)

    def relations(self):
        n = self.historical_window_weeks
        if self.var_confidence > n / (n + 1):
            raise ValueError("the window can't attain var_confidence")
        v = self.factor_sigma_multiples
        if not isinstance(v, tuple) or not 0 < len(v) <= 20 or len(set(v)) != len(v) or any(isinstance(x, bool) or not 0 < x <= 10 for x in v):
            raise ValueError("factor_sigma_multiples must be up to 20 distinct numbers in (0, 10]")


@dataclass(frozen=True)
class AnalysisConfig:
    data: DataConfig = DataConfig()
    pca: FactorConfig = FactorConfig()
    forecast: ForecastConfig = ForecastConfig()
    risk: RiskConfig = RiskConfig()

    def canonical(self) -> str:
        """The settings as sorted JSON, for hashing and replay."""
        return json.dumps(asdict(self), sort_keys=True)


_SECTIONS = {"data": DataConfig, "pca": FactorConfig, "forecast": ForecastConfig, "risk": RiskConfig}


def live_defaults(section: dict, today: str | None) -> dict:
    """Data settings as told; a live source whose end isn't told ends ``today`` and may not be older than LIVE_STALENESS_DAYS."""
    if today and section.get("source_mode") in ("live", "live_then_snapshot") and section.get("end_date") is None:
        told = {k: v for k, v in section.items() if v is not None}
        return {"maximum_staleness_days": LIVE_STALENESS_DAYS, **told, "end_date": today}
    return section


def _no_repeats(pairs):
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a key is given twice")
    return dict(pairs)


def load_config(path: str, today: str | None = None) -> AnalysisConfig:
    """Settings from a JSON file of at most 1 MB; repeated keys, unknown sections and unknown settings are refused.

    Lists become tuples. ``today`` is the clock for a live source (:func:`live_defaults`).
    """
    raw = Path(path).read_bytes()
    if len(raw) > 1_000_000:
        raise ValueError("the configuration is larger than 1 MB")
    given = json.loads(raw.decode("utf-8"), object_pairs_hook=_no_repeats)
    if not isinstance(given, dict) or not set(given) <= set(_SECTIONS):
        raise ValueError("unknown configuration sections")
    made = {}
    for name, kind in _SECTIONS.items():
        section = given.get(name, {})
        known = {f.name for f in fields(kind)}
        if not isinstance(section, dict) or not set(section) <= known:
            raise ValueError(f"unknown settings in {name}")
        section = {k: tuple(v) if isinstance(v, list) else v for k, v in section.items()}
        made[name] = kind(**(live_defaults(section, today) if name == "data" else section))
    return AnalysisConfig(**made)
