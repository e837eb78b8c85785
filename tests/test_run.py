import datetime as dt
import json

import numpy as np
import pytest

from panelfactor.plans import cli, run
from panelfactor.schema import TREASURY, TREASURY_CORE
from panelfactor.sources import positions

from .synthetic import factor_changes


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("run")
    core = 3.0 + np.cumsum(factor_changes(300, 4, (4.0, 2.0, 1.0)), axis=0) / 100
    spot = {n: core[:, k] for k, n in enumerate(TREASURY_CORE.names)}
    spot["1M"], spot["30Y"] = spot["3M"] + 0.01, spot["20Y"] + 0.01
    first = dt.date(2015, 1, 2)
    lines = ["Date," + ",".join(TREASURY.names)]
    lines += [f"{first + dt.timedelta(7 * k)}," + ",".join(f"{spot[n][k]:.6f}" for n in TREASURY.names) for k in range(300)]
    (at / "curve.csv").write_text("\n".join(lines))
    settings = {
        "data": {"start_date": "2015-01-01", "end_date": str(first + dt.timedelta(7 * 299 + 2)), "boundary_week_policy": "include_and_flag", "minimum_complete_weeks": 200, "maximum_end_coverage_gap_days": 7},
        "pca": {"rolling_window_years": 2, "minimum_rolling_observations": 104, "bootstrap_replications": 800, "bootstrap_sensitivity_replications": 800, "bootstrap_sensitivity_blocks": [13], "oos_minimum_training_observations": 104, "oos_minimum_holdout_observations": 52},
        "forecast": {"minimum_training_weeks": 104, "minimum_model_selection_observations": 20, "confirmation_observations": 20, "minimum_interval_observations": 20, "interval_history_weeks": 104, "interval_evaluation_observations": 52, "interval_bootstrap_block_lengths": [13], "interval_bootstrap_replications": 17600},
        "risk": {"historical_window_weeks": 104, "minimum_var_backtest_observations": 100},
    }
    (at / "settings.json").write_text(json.dumps(settings))
    (at / "krd.csv").write_text("tenor,dv01_usd_per_bp\n" + "\n".join(f"{n},{1000 * (k + 1)}" for k, n in enumerate(TREASURY_CORE.names)))
    said = dict.fromkeys(positions.METADATA, "id-1") | {"valuation_date": str(first + dt.timedelta(7 * 299)), "currency": "USD", "bump_bp": 1.0, "sign_convention": positions.SIGN, "curve_id": "UST-CMT"}
    (at / "krd.json").write_text(json.dumps(said))
    return at


def test_a_run_is_written_reused_and_guarded(spark, files, capsys):
    out = str(files / "runs")
    argv = ["--csv", str(files / "curve.csv"), "--config", str(files / "settings.json"), "--dv01", str(files / "krd.csv"), "--metadata", str(files / "krd.json"), "--output", out, "--as-of", "2020-10-01"]
    code = cli.main(argv, spark)
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code in (3, 4) and not told["reused"], told
    manifest = run.verify_run(told["run"], told["run"].rsplit("/", 1)[-1])
    assert {"weekly_changes.csv", "model_comparison.csv", "interval_coverage.csv", "tails.csv", "backtest.csv", "health.csv", "eligibility.csv", *(f"structural_{p}.csv" for p in run.MODEL_PARTS)} <= set(manifest["artifacts"])
    assert manifest["artifacts"]["weekly_changes.csv"]["rows"] == 299
    assert cli.main(argv, spark) == code and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["reused"]
    with open(told["run"] + "/tails.csv", "a") as f:
        f.write("x\n")
    with pytest.raises(ValueError, match="tails.csv"):
        run.verify_run(told["run"], told["run"].rsplit("/", 1)[-1])
    events = [json.loads(x) for x in (files / "runs" / "ledger.jsonl").read_text().splitlines()]
    assert [(e["event"], e.get("reused")) for e in events] == [("run", False), ("run", True)]


@pytest.mark.parametrize("argv", [["--csv", "a", "--snapshot", "b"], ["--nope"], ["--csv", "a", "--approval", "me-1"], ["--csv", "a", "--config", "x", "--end", "2020-01-01"], ["--snapshot", "a"]])
def test_bad_arguments_fail_and_are_logged(argv, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(argv) == 2 and json.loads((tmp_path / "outputs" / "ledger.jsonl").read_text())["event"] == "failure"


def test_exit_codes():
    ready, caveats, revision = "READY TO SHARE", "SHARE WITH CAVEATS", "NEEDS REVISION"
    assert run.exit_code([ready]) == 0 and run.exit_code([caveats]) == 3 and run.exit_code([caveats], accepted=True) == 0
    assert run.exit_code([ready], [revision], True) == 4
    with pytest.raises(ValueError):
        run.exit_code(["fine"])


def daily_panel(spark, lengths, seed=4):
    """Weekly observations of panels of several lengths, all ending on one day."""
    rows, last = [], dt.date(2020, 9, 25)
    for name, n in lengths.items():
        core = 3.0 + np.cumsum(factor_changes(n, seed, (4.0, 2.0, 1.0)), axis=0) / 100
        rows += [(name, last - dt.timedelta(7 * (n - 1 - k)), *map(float, core[k])) for k in range(n)]
    fields = ", ".join(f"`{n}` double" for n in TREASURY_CORE.names)
    return spark.createDataFrame(rows, f"panel string, date date, {fields}")


def small_settings(start="2010-01-01"):
    from panelfactor import config as cfg

    return cfg.AnalysisConfig(
        data=cfg.DataConfig(start_date=start, end_date="2020-09-27", boundary_week_policy="include_and_flag", minimum_complete_weeks=150, maximum_end_coverage_gap_days=7, maximum_start_coverage_gap_days=366),
        pca=cfg.FactorConfig(rolling_window_years=2, minimum_rolling_observations=104, bootstrap_replications=800, bootstrap_sensitivity_replications=800, bootstrap_sensitivity_blocks=(13,), oos_minimum_training_observations=104, oos_minimum_holdout_observations=100, minimum_ewma_effective_observations=100),
        forecast=cfg.ForecastConfig(minimum_training_weeks=104, minimum_model_selection_observations=20, confirmation_observations=20, minimum_interval_observations=20, interval_history_weeks=104, interval_evaluation_observations=52, interval_bootstrap_block_lengths=(13,), interval_bootstrap_replications=17_600),
    )


def test_panels_stand_apart(spark):
    """A short panel, and one that fails its checks, beside a long one: the long one's rows are those that it has alone."""
    daily = daily_panel(spark, {"long": 300, "short": 180, "broken": 120})
    both = run.analyse(daily, TREASURY_CORE, small_settings("2014-12-01"), as_of="2020-10-01")
    alone = run.analyse(daily.where("panel = 'long'"), TREASURY_CORE, small_settings("2014-12-01"), as_of="2020-10-01")
    told = {r.panel: r for r in both.tables["eligibility"].collect()}
    assert set(told) == {"long"} | ({"short"} & set(told)) and "broken" not in told
    assert told["long"].rolling_window == 104 and told["long"].forecasts and told["long"].out_of_sample
    said = {r.panel: r.assessment for r in both.assessment.collect()}
    assert said["broken"] == "NEEDS REVISION"
    if "short" in told:
        assert not told["short"].forecasts and not told["short"].out_of_sample
        health = {r.monitor: r.status for r in both.tables["health"].where("panel = 'short'").collect()}
        assert health["Out-of-sample RMSE"] == "WARN" and health["Methodology subspace angle"] == "WARN"
        assert "panels have fewer" in both.notes["forecasts"]
    for name in ("rolling_stability", "sequential_stability", "oos_metrics", "forecast_metrics", "interval_coverage", "joint_hits", "latest_bands", "health"):
        a, b = (sorted(repr([round(v, 8) if isinstance(v, float) else v for v in r]) for r in x.tables[name].where("panel = 'long'").collect()) for x in (both, alone))
        assert a and a == b, name
    both.close()
    alone.close()
    assert not __import__("os").path.exists(both.shelf.folder.removeprefix("file://"))


def test_all_panels_failing_is_an_error(spark):
    with pytest.raises(ValueError, match="data quality"):
        run.analyse(daily_panel(spark, {"broken": 120}), TREASURY_CORE, small_settings("2018-01-01"), as_of="2020-10-01")


def test_large_tables_are_guarded_and_a_crash_can_be_tried_again(spark, tmp_path, monkeypatch):
    import glob

    table = spark.range(2_000).selectExpr("cast(id as string) as t", "id", "id / 7 as x", "id % 2 = 0 as even", "if(id = 5, null, date'2020-01-01') as day")
    made = run.Analysis({"x": table.repartition(3)}, table.select("t"))
    shared = f"file://{tmp_path}/shared"
    whole = run.spread_contract

    def crash(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(run, "spread_contract", crash)
    with pytest.raises(RuntimeError):
        run.write_run(made, str(tmp_path / "runs"), "id", summary_rows=100, large_folder=shared)
    monkeypatch.setattr(run, "spread_contract", whole)
    path, reused = run.write_run(made, str(tmp_path / "runs"), "id", summary_rows=100, large_folder=shared)
    assert not reused and len(glob.glob(f"{tmp_path}/shared/id/*")) == 2  # nothing of the attempt before is left
    told = run.verify_run(path, "id")["large"]["x"]
    assert told["rows"] == 2000 and told["kinds"] == [["integer"], ["integer"], ["number"], ["boolean"], ["date", "missing"]] and len(told["sha256"]) == 64
    assert run.write_run(made, str(tmp_path / "runs"), "id", summary_rows=100, large_folder=shared)[1]
    part = sorted(glob.glob(f"{tmp_path}/shared/id/x-*/part-*"))[0]
    before = open(part, "rb").read()
    for bad in (before.replace(b",true", b",tampered", 1), before + b"1,2\n"):
        with open(part, "wb") as f:
            f.write(bad)
        for crc in glob.glob(f"{tmp_path}/shared/id/x-*/.*.crc"):
            __import__("os").remove(crc)
        with pytest.raises(ValueError):
            run.verify_run(path, "id")
        with pytest.raises(ValueError):
            run.write_run(made, str(tmp_path / "runs"), "id", summary_rows=100, large_folder=shared)


def test_names_of_a_run_are_fixed():
    base = set(run.BASE)
    run.refuse_other_names(base, {"forecasts": "left out on request"})
    run.refuse_other_names(base | set(run.FORECAST) | set(run.RISK) | {"hedge"}, {})
    for names, notes in ((base, {}), (base - {"health"}, {"forecasts": "x"}), (base | {"more"}, {"forecasts": "x"}), (base | {"tails"}, {"forecasts": "x"})):
        with pytest.raises(ValueError):
            run.refuse_other_names(names, notes)


def test_live_run_from_a_configuration_file(spark, files, tmp_path, capsys):
    """Settings with a live source: an injected network, the cache, a run that ends with caveats, read again from the cache."""
    payload = (files / "curve.csv").read_text().replace("Date,", "observation_date,", 1)
    head, _, body = payload.partition("\n")
    payload = ("observation_date," + ",".join(TREASURY.series_ids) + "\n" + body).encode()
    settings = json.loads((files / "settings.json").read_text())
    end = settings["data"].pop("end_date")
    settings["data"] |= {"source_mode": "live", "start_date": "2015-01-01", "cache_dir": str(tmp_path / "cache")}
    settings["forecast"]["enabled"] = False
    (tmp_path / "live.json").write_text(json.dumps(settings))
    argv = ["--config-json", str(tmp_path / "live.json"), "--output-dir", str(tmp_path / "runs"), "--as-of", end, "--log-level", "WARNING"]
    code = cli.main(argv, spark, fetch=lambda url, timeout: payload)
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code in (0, 3, 4) and "run" in told, told
    inside = json.loads(json.loads((tmp_path / "runs" / told["run"].rsplit("/", 1)[-1] / "manifest.json").read_text())["config"])
    assert inside["data"]["end_date"] == end and inside["data"]["maximum_staleness_days"] == 7

    def down(url, timeout):
        raise OSError("no network")

    assert cli.main(argv, spark, fetch=down) == code and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["reused"]


def test_options_have_their_public_names():
    known = {s for action in cli.parser()._actions for s in action.option_strings}
    assert {"--project-root", "--config-json", "--dump-effective-config", "--start-date", "--end-date", "--source-mode", "--output-dir", "--maximum-staleness-days", "--krd-csv", "--krd-as-of", "--krd-curve-id", "--krd-currency", "--krd-bump-bp", "--portfolio-id", "--position-snapshot-id", "--sensitivity-engine-id", "--skip-forecast", "--accept-warnings", "--warning-approval-id", "--log-level"} <= known
    a = cli.parser().parse_args(["--krd-csv", "k.csv", "--krd-as-of", "2024-01-05", "--krd-curve-id", "c", "--portfolio-id", "p", "--position-snapshot-id", "s", "--sensitivity-engine-id", "e"])
    assert sorted(cli.told_metadata(a)) == sorted(positions.METADATA) and cli.APPROVAL.fullmatch("A")
