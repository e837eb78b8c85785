"""The whole analysis of a daily panel, as lazy tables, and its results as a verified folder."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import AnalysisConfig
from ..functions.shelf import Shelf, forget
from ..functions.stats import distribution_table
from ..operators import factors, forecast, intervals, moments, panel, quality, risk, stability
from ..schema import DATE, PANEL, POS, WITH_CAVEATS, Nodes, col

STEP = 13
METHOD_CHANGE = "2021-12-06"

#: Names of a run's tables: those of every run, those of runs with forecasts, with positions, and what settings may add.
MODEL_PARTS = ("components", "centre_scale", "loadings", "physical_basis", "one_sigma_shocks", "scores")
BASE = (
    "weekly_curve", "weekly_changes", "quality_checks", "eligibility", "specifications", "recent_comparison", "reconstruction", "methodology", "rolling_stability", "sequential_stability", "bootstrap", "block_sensitivity",
    "oos_reconstruction", "oos_metrics", "distribution", "algebra", "health", "assessment", *(f"{model}_{part}" for model in ("structural", "recent", "correlation") for part in MODEL_PARTS),
)
FORECAST = ("forecasts", "forecast_metrics", "model_comparison", "latest_forecast", "latest_bands", "interval_coverage", "interval_coverage_full", "joint_hits")
RISK = ("pnl", "tails", "backtest_detail", "backtest", "worst_scenarios", "factor_scenarios", "variance", "variance_recent", "calibrations")
OPTIONAL = ("extended_specifications", "hedge")


@dataclass
class Analysis:
    """Result tables by name: those that others start from are written already, the rest is computed when read. ``notes`` says why a table is absent."""

    tables: dict[str, DataFrame]
    assessment: DataFrame
    notes: dict[str, str] = field(default_factory=dict)
    shelf: Shelf | None = None

    def close(self) -> None:
        """Delete what the analysis has written for its tables; they can't be read any more."""
        if self.shelf:
            self.shelf.clear()


def analyse(daily: DataFrame, nodes: Nodes, config: AnalysisConfig, mode: str = "SNAPSHOT", as_of: str | None = None, dv01: DataFrame | None = None, instruments: DataFrame | None = None, hedge_bounds: tuple[float, float] | None = None, universe: Nodes | None = None, forecasts: bool = True) -> Analysis:
    """Quality, factors, stability, forecasts, intervals, health and (with ``dv01``) risk of every panel of ``daily``.

    ``universe``: the nodes that ``daily`` has, of which ``nodes`` are analysed; quality looks at all of them, and where
    it is larger, the models of both are held side by side. ``as_of`` is the clock (none: today in New York).

    Panels stand apart. One that fails a quality check, or is too short for the rolling windows or the recency weights, has its
    checks and its assessment and no other rows; if all fail, the analysis raises. The rolling window (the settings' years,
    or all of a panel's changes), whether there are adjacent windows, an out-of-sample part and forecasts, follow from each
    panel's own length (table ``eligibility``). What several tables start from lies in the shared folder (:class:`Shelf`) until :meth:`Analysis.close`.
    """
    d, f, w, r = config.data, config.pca, config.forecast, config.risk
    names, k = nodes.names, f.retained_factors
    as_of = as_of or datetime.now(ZoneInfo("America/New_York")).date().isoformat()
    universe = universe or nodes
    thresholds = {"least_similarity": f.minimum_template_similarity, "least_margin": f.minimum_template_dominance_margin}
    shelf = Shelf(daily.sparkSession)
    keep = shelf.put

    weekly = keep(panel.weekly_curve(daily, names, d.anchor, d.boundary_week_policy, d.start_date, d.end_date), "weekly")
    all_changes = keep(panel.changes(weekly, names), "changes")
    metrics = quality.quality_metrics(daily, weekly, all_changes, universe, names, d.anchor, d.boundary_week_policy, d.start_date, d.end_date)
    sizes = all_changes.groupBy(PANEL).agg(F.count("*").alias("n"))
    checks = quality.quality_checks(metrics, d, mode, as_of, METHOD_CHANGE)
    checks = keep(checks.unionByName(quality.history_checks(sizes, f.minimum_rolling_observations, f.current_halflife_weeks, f.minimum_ewma_effective_observations)), "checks")
    fit_panels = keep(quality.without_failures(checks), "panels")
    changes = keep(all_changes.join(fit_panels, PANEL, "left_semi"), "fit-changes")
    n = F.col("n_rows")
    width = F.least(F.lit(52 * f.rolling_window_years), n.cast("int"))
    oos_rows = f.oos_minimum_training_observations + f.oos_minimum_holdout_observations
    eligibility = keep(
        changes.select(PANEL, "n_rows").distinct().select(
            PANEL, n.alias("n_changes"), width.alias("rolling_window"), (n >= 2 * width).alias("sequential"), (n >= oos_rows).alias("out_of_sample"),
            ((n >= w.required_rows) & F.lit(w.enabled and forecasts)).alias("forecasts"),
        ),
        "eligibility",
    )

    t: dict[str, DataFrame] = {"weekly_curve": weekly, "weekly_changes": all_changes, "quality_checks": checks, "eligibility": eligibility}
    notes: dict[str, str] = {}
    structural = keep(factors.fit(changes, nodes, **thresholds), "structural")
    recent = keep(factors.fit(changes, nodes, halflife=f.current_halflife_weeks, **thresholds), "recent")
    correlation = keep(factors.fit(changes, nodes, standardize=True, **thresholds), "correlation")
    for name, model in (("structural", structural), ("recent", recent), ("correlation", correlation)):
        t |= {f"{name}_{part}": table for part, table in factors.artifacts(changes, model, nodes, k).items()}
    t["specifications"] = stability.specifications(changes, nodes, f.current_halflife_weeks, k, **thresholds)
    if universe.names != nodes.names:
        t["extended_specifications"] = stability.extended_specifications(daily.join(fit_panels, PANEL, "left_semi"), nodes, universe, d.anchor, d.boundary_week_policy, d.start_date, d.end_date, k, **thresholds)
    t["recent_comparison"] = factors.regime_table(factors.compare_models(structural, recent, k))
    t["reconstruction"] = factors.error_metrics(factors.reconstruct(changes, structural, nodes, k))
    t["methodology"] = stability.regimes(changes, nodes, METHOD_CHANGE, k, f.minimum_methodology_regime_observations, **thresholds)

    rolling = keep(stability.rolling(changes, structural, nodes, width, STEP, k, **thresholds), "rolling")
    sequential = keep(stability.sequential(changes, nodes, width, STEP, k, **thresholds), "sequential")
    t |= {"rolling_stability": rolling, "sequential_stability": sequential}
    draw = lambda replications, lengths: stability.bootstrap_summary(stability.bootstrap(changes, structural, nodes, replications, lengths, k, f.random_seed, **thresholds), k, f.random_seed)
    t["bootstrap"] = draw(f.bootstrap_replications, (f.bootstrap_block_weeks,))
    t["block_sensitivity"] = stability.block_sensitivity(draw(f.bootstrap_sensitivity_replications, f.bootstrap_sensitivity_blocks))
    oos = keep(stability.oos_reconstruction(changes.where(n >= oos_rows), nodes, f.oos_minimum_training_observations, f.oos_refit_every_observations, k), "oos")
    t |= {"oos_reconstruction": oos, "oos_metrics": factors.error_metrics(oos)}

    scores = factors.transform(changes, structural, nodes).select(PANEL, POS, F.posexplode(F.slice("scores", 1, k)).alias("factor", "score"))
    t["distribution"] = keep(distribution_table(scores, [PANEL, "factor"], POS, "score"), "distribution")
    weight = moments.ewma_weight(f.current_halflife_weeks)
    calibrations = (("structural", structural, None, False), ("recent", recent, weight, False), ("correlation", correlation, None, True))
    checked = [quality.algebra_checks(changes, model, moments.moments(changes, names, weight=w_), nodes, k, standardized=unit, weight=w_, **thresholds).withColumn("calibration", F.lit(name)) for name, model, w_, unit in calibrations]
    algebra = keep(checked[0].unionByName(checked[1]).unionByName(checked[2]), "algebra")
    t["algebra"] = algebra
    health = quality.health_table(
        rolling, t["oos_metrics"], sequential, t["recent_comparison"], t["methodology"], f.maximum_principal_angle_warning_degrees, f.minimum_loading_cosine_warning, f.maximum_oos_rmse_warning_bp,
        f.maximum_current_factor_sigma_ratio_warning, f.maximum_methodology_subspace_angle_warning_degrees, f.maximum_methodology_sigma_ratio_warning, fit_panels,
    )

    walkers = eligibility.where("forecasts").select(PANEL)
    n_walkers, n_panels = walkers.count(), eligibility.count()
    if not (w.enabled and forecasts):
        notes["forecasts"] = "left out on request"
    elif n_walkers < n_panels:
        notes["forecasts"] = f"{n_panels - n_walkers} of {n_panels} panels have fewer than the {w.required_rows} changes that the forecast settings need"
    if n_walkers:
        walked, levels = keep(changes.join(walkers, PANEL, "left_semi"), "walked"), weekly.join(walkers, PANEL, "left_semi")
        forecast.check_inputs(walked, nodes, w.minimum_training_weeks, levels, w.level_change_reconciliation_tolerance_bp)
        made = keep(forecast.walk_forward(walked, nodes, w.minimum_training_weeks, w.retained_factors, w.ar_coefficient_bound, w.var_ridge), "walks")
        gate = keep(forecast.adoption_gate(made, w.interval_evaluation_observations, w.confirmation_observations, w.adoption_alpha, w.minimum_rmse_improvement, w.hac_lags), "gate")
        rows = keep(intervals.selected_residuals(made, gate), "residuals")
        evidence = {"tolerance": w.interval_coverage_tolerance, "alpha": w.interval_validation_alpha, "block_lengths": w.interval_bootstrap_block_lengths, "replications": w.interval_bootstrap_replications, "seed": w.interval_bootstrap_random_seed}
        t |= {"forecasts": forecast.partitioned(made, w.interval_evaluation_observations, w.confirmation_observations), "forecast_metrics": forecast.forecast_metrics(made), "model_comparison": gate}
        latest = forecast.latest_forecast(levels, walked, gate, nodes, w.retained_factors, w.ar_coefficient_bound, w.var_ridge)
        t |= {"latest_forecast": latest, "latest_bands": intervals.latest_bands(rows, latest, w.interval_history_weeks)}
        t["interval_coverage"] = keep(intervals.coverage(rows, nodes, w.interval_history_weeks, w.minimum_interval_observations, evaluate_last=w.interval_evaluation_observations, **evidence), "coverage")
        t["interval_coverage_full"] = keep(intervals.coverage(rows, nodes, w.interval_history_weeks, w.minimum_interval_observations, None, **evidence), "coverage-full")
        t["joint_hits"] = intervals.joint_hits(intervals.hits(rows, w.interval_history_weeks, w.minimum_interval_observations, evaluate_last=w.interval_evaluation_observations))
        health = health.unionByName(quality.monitor(t["interval_coverage"], "Interval evidence margin", F.min(F.col("low") - F.col("floor")), 0.0, False))
        health = health.unionByName(quality.monitor(t["interval_coverage_full"], "Long-history coverage gap", F.min("gap"), -w.interval_coverage_tolerance, False))
    t["health"] = health = keep(health, "health")

    if dv01 is not None:
        if wrong := risk.dv01_defects(dv01, changes, nodes).limit(3).collect():
            raise ValueError("sensitivities: " + "; ".join(f"{x.panel} {x.node} {x.defect}" for x in wrong))
        pnl = risk.linear_pnl(changes, dv01, nodes)
        detail = risk.backtest_detail(pnl, r.historical_window_weeks, r.var_confidence)
        tails = [risk.tail_summary(pnl, n, r.var_confidence, r.es_confidence, r.minimum_effective_tail_mass_review) for n in (r.historical_window_weeks, None)]
        t |= {"pnl": risk.factor_pnl(changes, dv01, structural, nodes, k), "tails": tails[0].unionByName(tails[1]), "backtest_detail": detail, "backtest": risk.backtest_summary(detail, r.historical_window_weeks, r.var_confidence, r.backtest_alpha, r.minimum_var_backtest_observations)}
        t |= {"worst_scenarios": risk.worst_scenarios(changes, dv01, nodes, 10), "factor_scenarios": risk.factor_scenarios(structural, dv01, nodes, k, r.factor_sigma_multiples)}
        t |= {"variance": risk.variance_table(structural, dv01, nodes, k), "variance_recent": risk.variance_table(recent, dv01, nodes, k), "calibrations": risk.calibration_comparison(structural, recent, dv01, nodes, k)}
        if instruments is not None and hedge_bounds:
            t["hedge"] = risk.hedge(structural, dv01, instruments, nodes, hedge_bounds, max(abs(x) for x in hedge_bounds))
    return Analysis(t, quality.assessment(checks, algebra, t["distribution"], health), notes, shelf)


def risk_disposition(analysis: Analysis, valuation_date: str, max_gap_days: int) -> DataFrame:
    """panel, disposition: positions after the market's last date or too far from it, or a back-test that does not pass, need revision; else caveats."""
    last = analysis.tables["weekly_curve"].groupBy(PANEL).agg(F.max(DATE).alias("last"))
    lag = F.datediff(F.col("last"), F.lit(valuation_date).cast("date"))
    tails = analysis.tables["tails"].groupBy(PANEL).agg(F.bool_or(F.col("status") != "REVIEW LEVEL MET").alias("thin"))
    joined = last.join(analysis.tables["backtest"].select(PANEL, "status"), PANEL, "left").join(tails, PANEL, "left")
    bad = ~lag.between(0, max_gap_days) | (F.coalesce("status", F.lit("")) != "PASS") | F.coalesce("thin", F.lit(True))
    return joined.select(PANEL, F.when(bad, "NEEDS REVISION").otherwise(WITH_CAVEATS).alias("disposition"))


def run_identity(config: AnalysisConfig, content: list, position_sha: str | None = None, metadata: dict | None = None) -> str:
    """SHA-256 over settings, the data's content hashes, positions, the library's own files and version, and the versions under it."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = hashlib.sha256()
    for folder, _, files in sorted(os.walk(here)):
        for name in sorted(x for x in files if x.endswith(".py") and f"{os.sep}llm" not in folder):
            with open(os.path.join(folder, name), "rb") as f:
                code.update(name.encode() + b"\0" + f.read())
    import platform

    import numpy
    import pandas
    import pyspark

    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__, "panelfactor": __version__}
    parts = [config.canonical(), content, position_sha, metadata, code.hexdigest(), versions]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _digest(path: str) -> tuple[int, str]:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return os.path.getsize(path), h.hexdigest()


def _flat(table: DataFrame) -> DataFrame:
    """Arrays as JSON text, for CSV."""
    return table.select(*(F.to_json(col(x.name)).alias(x.name) if x.dataType.typeName() in ("array", "struct", "map") else col(x.name) for x in table.schema))


def contract(path: str) -> dict:
    """Rows, header, size and hash of a CSV artifact, and the kinds of values in each column; ragged rows and repeated headers are errors."""
    size, sha = _digest(path)
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.reader(f)
        header = next(rows)
        if len(set(header)) != len(header):
            raise ValueError(f"{path} repeats a column name")
        kinds: list[set[str]] = [set() for _ in header]
        n = 0
        for n, row in enumerate(rows, start=1):
            if len(row) != len(header):
                raise ValueError(f"row {n} of {path} has {len(row)} values for {len(header)} columns")
            for own, value in zip(kinds, row, strict=True):
                own.add(_kind(value))
    return {"bytes": size, "sha256": sha, "rows": n, "columns": header, "kinds": [sorted(k) for k in kinds]}


def _kind(value: str) -> str:
    if value == "":
        return "missing"
    if value in ("true", "false"):
        return "boolean"
    try:
        float(value)
    except ValueError:
        return "date" if len(value) == 10 and value[4] == value[7] == "-" and value.replace("-", "").isdigit() else "text"
    return "number" if any(c in value for c in ".eEn") else "integer"


def _shown(value):
    return "" if value is None else str(value).lower() if isinstance(value, bool) else value


def _kind_column(c):
    """:func:`_kind` as a column expression."""
    text = F.coalesce(c, F.lit(""))
    number = text.try_cast("double")
    shown = F.when(text == "", "missing").when(text.isin("true", "false"), "boolean").when(text.rlike(r"^[+-]?[0-9]+$"), "integer").when(number.isNotNull(), "number")
    return shown.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").otherwise("text")


def spread_contract(spark, folder: str, columns: list[str]) -> dict:
    """Contract of a table that Spark wrote as CSV parts: rows, kinds of values by column, and a hash tree of the parts.

    Two aggregations over the files; a name, a size and a hash for each part reach the driver. Rows whose number of
    values differs from the header's are an error.
    """
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    told = parts.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).orderBy("name").collect()
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_ragged"])
    raw = spark.read.option("header", True).option("escape", '"').option("enforceSchema", True).option("columnNameOfCorruptRecord", "_ragged").schema(schema).csv(folder)
    kinds = raw.agg(F.count("*").alias("n"), F.count("_ragged").alias("ragged"), *(F.array_sort(F.collect_set(_kind_column(col(c)))).alias(f"k{i}") for i, c in enumerate(columns))).first()
    if kinds.ragged:
        raise ValueError(f"{kinds.ragged} rows of {folder} don't have {len(columns)} values")
    tree = hashlib.sha256("".join(f"{r.name}{r.sha256}" for r in told).encode()).hexdigest()
    return {"folder": folder, "columns": columns, "rows": kinds.n, "kinds": [kinds[f"k{i}"] for i in range(len(columns))], "sha256": tree, "parts": [r.asDict() for r in told]}


def write_run(analysis: Analysis, folder: str, identity: str, extra: dict | None = None, summary_rows: int = 1_000_000, large_folder: str | None = None) -> tuple[str, bool]:
    """(run folder, reused): one CSV for each table below ``folder``/``identity``, with a manifest of hashes and contracts.

    A table of over ``summary_rows`` rows (a count decides) is written by Spark below ``large_folder``, a place that all
    executors share, in a folder of this attempt's own: the manifest, which appears last and by one rename with the whole
    run, is what commits it. What an earlier attempt left there is deleted first. Without such a place it is an error. An existing
    run is reused only if every file, large parts included, still has its hash and contract.
    """
    final = os.path.join(folder, identity)
    if os.path.isdir(final):
        verify_run(final, identity)
        return final, True
    os.makedirs(folder, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=".stage-", dir=folder)
    artifacts, large = {}, {}
    tables = {**analysis.tables, "assessment": analysis.assessment}
    spark = analysis.assessment.sparkSession
    attempts = f"{large_folder.rstrip('/')}/{identity}" if large_folder else None
    try:
        if attempts:
            forget(spark, attempts)
        for name, table in tables.items():
            flat = _flat(table)
            if flat.limit(summary_rows + 1).count() > summary_rows:
                if not attempts:
                    raise ValueError(f"{name} has over {summary_rows} rows: give a shared folder for large tables")
                place = f"{attempts}/{name}-{uuid.uuid4().hex}"
                flat.write.option("header", True).option("escape", '"').csv(place)
                large[name] = spread_contract(spark, place, flat.columns)
                continue
            path = os.path.join(stage, f"{name}.csv")
            with open(path, "w", encoding="utf-8", newline="") as f:
                out = csv.writer(f, lineterminator="\n")
                out.writerow(flat.columns)
                for row in flat.toLocalIterator(prefetchPartitions=True):
                    out.writerow([_shown(v) for v in row])
            artifacts[f"{name}.csv"] = contract(path)
        refuse_other_names(set(tables), analysis.notes)
        manifest = {"identity": identity, "artifacts": artifacts, "large": large, "notes": analysis.notes, **(extra or {})}
        with open(os.path.join(stage, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump(manifest, f, sort_keys=True, default=str)
        try:
            os.rename(stage, final)
        except OSError:
            if not os.path.isdir(final):
                raise
            verify_run(final, identity)  # another run was first
            return final, True
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return final, False


def refuse_other_names(names: set[str], notes: dict[str, str]) -> None:
    """Raise unless a whole analysis's tables are those of BASE, and all or none of FORECAST and RISK; parts of one (tests, callers' own) pass."""
    if "weekly_changes" not in names:
        return
    wanted = set(BASE) | (set(FORECAST) if names & set(FORECAST) else set()) | (set(RISK) if names & set(RISK) else set())
    if odd := (names ^ wanted) - set(OPTIONAL):
        raise ValueError(f"the run's tables differ from those expected: {sorted(odd)}")
    if not names & set(FORECAST) and "forecasts" not in notes:
        raise ValueError("forecasts are absent without a reason")


def verify_run(path: str, identity: str, spark=None) -> dict:
    """The manifest of a run whose files all match it, parts of large tables too; an error otherwise."""
    with open(os.path.join(path, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    names = set(os.listdir(path)) - {"manifest.json"}
    if manifest["identity"] != identity or names != set(manifest["artifacts"]):
        raise ValueError("the run holds other artifacts than its manifest names")
    for name, told in manifest["artifacts"].items():
        if contract(os.path.join(path, name)) != told:
            raise ValueError(f"{name} has changed since it was written")
    for name, told in manifest["large"].items():
        spark = spark or SparkSession.active()
        try:
            now = spread_contract(spark, told["folder"], told["columns"])
        except AnalysisException as gone:
            raise ValueError(f"{name} is no longer in {told['folder']}") from gone
        if now != told:
            raise ValueError(f"{name} has changed since it was written")
    return manifest


def append_event(folder: str, event: dict) -> None:
    """One line more in ``folder``/ledger.jsonl, under a lock, synced."""
    import fcntl

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "ledger.jsonl"), "ab") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write((json.dumps({"at": datetime.now(timezone.utc).isoformat(), **event}, sort_keys=True, default=str) + "\n").encode())
        f.flush()
        os.fsync(f.fileno())


def exit_code(assessments, dispositions=(), accepted: bool = False) -> int:
    """0 if all is ready or caveats are accepted, 3 for caveats, 4 for revision; other words are an error."""
    said = {*assessments, *dispositions}
    if unknown := said - {"NEEDS REVISION", WITH_CAVEATS, "READY TO SHARE"}:
        raise ValueError(f"unknown assessments: {sorted(unknown)}")
    return 4 if "NEEDS REVISION" in said else 3 if WITH_CAVEATS in said and not accepted else 0
