"""Spark-native analytics of time-indexed multi-node panels: curves, factors, stability, forecasts, bands, risk.

The names below are the public interface; see :mod:`panelfactor.api`. They are loaded on first use.
"""

from __future__ import annotations

__version__ = "0.2.0"
__all__ = [
    "ALL_TENORS", "CORE_TENORS", "FRED_SERIES", "MATURITY_YEARS",
    "DataConfig", "PCAConfig", "ForecastConfig", "RiskConfig", "PipelineConfig",
    "DataProvenance", "CurveDataBundle", "PCAFit", "ForecastResult", "RiskMappingResult", "HedgeResult", "ValidationSummary", "PipelineResult",
    "load_curve_data", "fit_curve_pca", "walk_forward_forecast", "map_linear_curve_risk", "optimize_key_rate_hedge", "run_pipeline",
]


def __getattr__(name: str):
    if name not in __all__:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from . import api

    return getattr(api, name)
