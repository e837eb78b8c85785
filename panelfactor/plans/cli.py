"""Command line: analyse a Treasury-style curve and write a verified run.

python -m panelfactor.plans.cli --csv curve.csv --output-dir runs [--config-json settings.json] [--krd-csv krd.csv with what it
is: --krd-as-of, --krd-curve-id, --portfolio-id, --position-snapshot-id, --sensitivity-engine-id, or --metadata krd.json]
[--instruments hedges.csv --hedge-bound N] [--accept-warnings --warning-approval-id ID]. Without --csv the source is the settings':
a snapshot with its manifest, or live | live_then_snapshot. Exit codes: 0 ready or accepted, 2 failure, 3 caveats, 4 needs revision.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
from dataclasses import replace
from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from ..config import AnalysisConfig, DataConfig, live_defaults, load_config
from ..schema import TREASURY
from ..sources import panels, positions
from . import run

APPROVAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}")
LOG = logging.getLogger("panelfactor")


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    """Options; where two names are given the first is the public one."""
    p = _Parser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--project-root", help="folder that relative paths of the settings are taken from (none: the working directory)")
    p.add_argument("--csv", help="daily panel, plain or gzip")
    p.add_argument("--snapshot", help="verified daily panel in place of the settings' snapshot_path; needs --manifest")
    p.add_argument("--manifest")
    p.add_argument("--config-json", "--config", dest="config", help="JSON settings; excludes the data options below")
    p.add_argument("--start-date", "--start", dest="start")
    p.add_argument("--end-date", "--end", dest="end", help="none: 2025-12-31 for a snapshot, today in New York for live modes")
    p.add_argument("--weekly-rule", "--anchor", dest="weekly_rule", help="W-MON to W-SUN")
    p.add_argument("--policy")
    p.add_argument("--source-mode", choices=("snapshot", "live", "live_then_snapshot"), help="where the curve comes from, unless --csv names it")
    p.add_argument("--cache", help="folder of live payloads, in place of the settings' cache_dir")
    p.add_argument("--maximum-staleness-days", type=int)
    p.add_argument("--skip-forecast", action="store_true")
    p.add_argument("--dump-effective-config", help="write the settings in force to this file")
    p.add_argument("--instruments", help="hedges as CSV: instrument, tenor, dv01_usd_per_bp")
    p.add_argument("--hedge-bound", type=float, help="largest quantity of a hedge, either way")
    p.add_argument("--output-dir", "--output", dest="output", default="outputs")
    p.add_argument("--large-folder", help="shared folder for tables of over a million rows (none: below the output, with a local master)")
    p.add_argument("--krd-csv", "--dv01", dest="dv01", help="sensitivities as CSV: tenor, dv01_usd_per_bp")
    p.add_argument("--metadata", help="what the sensitivities are, as JSON, in place of the options below")
    p.add_argument("--krd-as-of", dest="valuation_date")
    p.add_argument("--krd-curve-id", "--curve-id", dest="curve_id")
    p.add_argument("--krd-currency", dest="currency", choices=("USD",))
    p.add_argument("--krd-bump-bp", dest="bump_bp", type=float)
    p.add_argument("--sign-convention", dest="sign_convention")
    p.add_argument("--portfolio-id")
    p.add_argument("--position-snapshot-id")
    p.add_argument("--sensitivity-engine-id", dest="risk_engine_id")
    p.add_argument("--accept-warnings", action="store_true")
    p.add_argument("--warning-approval-id", "--approval", dest="approval", help="identifier of who accepts caveats")
    p.add_argument("--as-of", default=None, help="the clock, for tests and replays")
    p.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR"), default="INFO")
    return p


def told_metadata(a) -> dict | None:
    """Metadata of the sensitivities from their file or from options, not from both; currency, bump and sign have one value each."""
    given = {k: v for k in positions.METADATA if (v := getattr(a, k)) is not None}
    told = set(given) - {"curve_id"}
    if a.metadata:
        if told:
            raise ValueError("metadata come from a file or from options")
        with open(a.metadata, encoding="utf-8") as f:
            return json.load(f)
    return {"currency": "USD", "bump_bp": 1.0, "sign_convention": positions.SIGN, **given} if told or a.dv01 else None


def dump_config(config: AnalysisConfig, path: str) -> None:
    """The settings as sorted JSON, put in place by one rename."""
    beside = f"{path}.{os.getpid()}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(config.canonical() + "\n")
    os.replace(beside, path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetch=None) -> int:
    """Run the command line; ``fetch`` (url, timeout) stands in for the network in tests."""
    stage, output, made, daily = "arguments", "outputs", None, None
    try:
        a = parser().parse_args(argv)
        output = a.output
        LOG.setLevel(a.log_level)
        if a.accept_warnings != bool(a.approval) or (a.approval and not APPROVAL.fullmatch(a.approval)):
            raise ValueError("accepted warnings and an approval identifier belong together")
        overrides = {"start_date": a.start, "end_date": a.end, "weekly_rule": a.weekly_rule, "boundary_week_policy": a.policy, "source_mode": a.source_mode, "maximum_staleness_days": a.maximum_staleness_days}
        overrides = {k: v for k, v in overrides.items() if v is not None}
        if a.config and overrides:
            raise ValueError("a configuration file excludes the data options")
        if (a.csv and a.snapshot) or bool(a.snapshot) != bool(a.manifest) or (a.csv and a.source_mode in ("live", "live_then_snapshot")):
            raise ValueError("give --csv, or --snapshot with --manifest, or a live --source-mode")
        if bool(a.instruments) != (a.hedge_bound is not None) or (a.instruments and not a.dv01):
            raise ValueError("hedges need --instruments, --hedge-bound and --dv01")
        today = date.fromisoformat(a.as_of) if a.as_of else datetime.now(ZoneInfo("America/New_York")).date()
        stage = "configuration"
        config = load_config(a.config, today.isoformat()) if a.config else AnalysisConfig(data=DataConfig(**live_defaults(overrides, today.isoformat())))
        if a.skip_forecast:
            config = replace(config, forecast=replace(config.forecast, enabled=False))
        if a.dump_effective_config:
            dump_config(config, a.dump_effective_config)
        metadata = told_metadata(a)
        positions.check_metadata(metadata, bool(a.dv01), a.curve_id or "UST-CMT", today)
        stage = "source"
        LOG.info("source %s, %s to %s", "csv" if a.csv else config.data.source_mode, config.data.start_date, config.data.end_date)
        spark = spark or SparkSession.builder.getOrCreate()
        nodes = TREASURY.subset(config.data.core_tenors)
        at = lambda path: os.path.join(a.project_root, path) if a.project_root else path
        if a.csv:
            daily, mode = panels.read_csv_panel(spark, a.csv, TREASURY, config.data), "SNAPSHOT"
        else:
            snapshot = (a.snapshot, a.manifest) if a.snapshot else panels.resolve_snapshot(config.data, a.project_root) if config.data.source_mode == "snapshot" else None
            daily, proof = panels.read_source(spark, config.data, TREASURY, snapshot, fetch or panels.http_fetch(config.data.maximum_response_bytes), a.cache or at(config.data.cache_dir), as_of=today.isoformat())
            mode = proof.mode
        dv01, sha = positions.read_dv01(spark, a.dv01, nodes) if a.dv01 else (None, None)
        stage = "analysis"
        instruments = positions.read_instruments(spark, a.instruments, nodes) if a.instruments else None
        daily = daily.select("panel", "date", *(f"`{n}`" for n in TREASURY.names)).persist()
        content = [tuple(r) for r in panels.canonical_digest(daily, TREASURY).collect()]
        bounds = (-a.hedge_bound, a.hedge_bound) if a.instruments else None
        made = run.analyse(daily, nodes, config, mode, today.isoformat(), dv01, instruments, bounds, universe=TREASURY)
        said = sorted({r.assessment for r in made.assessment.collect()})
        risks = sorted({r.disposition for r in run.risk_disposition(made, metadata["valuation_date"], config.risk.maximum_krd_asof_gap_days).collect()}) if metadata else []
        stage = "output"
        identity = run.run_identity(config, content, sha, metadata)
        local = spark.conf.get("spark.master", "").startswith("local") and not spark.conf.get("spark.master", "").startswith("local-cluster")
        large = a.large_folder or (f"file://{os.path.abspath(output)}/large" if local else None)
        path, reused = run.write_run(made, output, identity, {"config": config.canonical(), "content": content, "positions": metadata}, large_folder=large)
        code = run.exit_code(said, risks, a.accept_warnings)
        run.append_event(output, {"event": "run", "identity": identity, "reused": reused, "assessment": said, "risk": risks, "approval": a.approval, "exit": code})
        LOG.info("run %s, exit %d", path, code)
        print(json.dumps({"run": path, "reused": reused, "assessment": said, "risk": risks}))
        return code
    except Exception as e:  # noqa: BLE001  every failure is told and logged
        LOG.debug("failure", exc_info=True)
        run.append_event(output, {"event": "failure", "stage": stage, "error": f"{type(e).__name__}: {e}"[:500]})
        print(json.dumps({"stage": stage, "error": str(e)[:500]}))
        return 2
    finally:
        if made is not None:
            made.close()
        if daily is not None:
            daily.unpersist()


if __name__ == "__main__":
    raise SystemExit(main())
