import datetime as dt
import json

import numpy as np
import pytest

import panelfactor
from panelfactor.operators import factors
from panelfactor.plans import cli, run
from panelfactor.schema import TREASURY, TREASURY_CORE, Nodes
from panelfactor.sources import panels

from .synthetic import factor_changes


@pytest.fixture(scope="module")
def curve(tmp_path_factory):
    """A daily curve of all tenors as CSV: Fridays of 160 weeks."""
    at = tmp_path_factory.mktemp("api")
    core = 3.0 + np.cumsum(factor_changes(160, 4, (4.0, 2.0, 1.0)), axis=0) / 100
    spot = {n: core[:, k] for k, n in enumerate(TREASURY_CORE.names)}
    spot["1M"], spot["30Y"] = spot["3M"] + 0.01, spot["20Y"] + 0.01
    first = dt.date(2015, 1, 2)
    lines = ["Date," + ",".join(TREASURY.names)] + [f"{first + dt.timedelta(7 * k)}," + ",".join(f"{spot[n][k]:.6f}" for n in TREASURY.names) for k in range(160)]
    (at / "curve.csv").write_text("\n".join(lines) + "\n")
    return at, str(first + dt.timedelta(7 * 159 + 2))


def test_every_public_name_is_there():
    assert len(panelfactor.__all__) == 23 and all(getattr(panelfactor, n) is not None for n in panelfactor.__all__)
    with pytest.raises(AttributeError):
        panelfactor.nothing  # noqa: B018


def test_the_verbs_work_together(spark, curve):
    at, end = curve
    config = panelfactor.DataConfig(start_date="2015-01-01", end_date=end, boundary_week_policy="include_and_flag", minimum_complete_weeks=100)
    data = panelfactor.load_curve_data(spark, config, csv=str(at / "curve.csv"))
    assert data.changes.count() == 159 and data.provenance.rows == 160
    fit = panelfactor.fit_curve_pca(data.changes, data.nodes)
    assert fit.score_unit.startswith("hundredths") and fit.components(3).count() == 3
    assert {fit.component_of(s).first().component for s in factors.SHAPES} == {1, 2, 3}
    dv01 = spark.createDataFrame([("curve", n, 1000.0) for n in data.nodes.names], "panel string, node string, dv01 double")
    got = panelfactor.map_linear_curve_risk(data.changes, dv01, fit, panelfactor.RiskConfig(historical_window_weeks=104, minimum_var_backtest_observations=100))
    assert got.tables["worst_scenarios"].count() == 10
    with pytest.raises(ValueError):
        panelfactor.map_linear_curve_risk(data.changes, dv01, fit, k=0)
    hedges = spark.createDataFrame([("curve", "h", n, 100.0 if n == "10Y" else 0.0) for n in data.nodes.names], "panel string, instrument string, node string, dv01 double")
    assert panelfactor.optimize_key_rate_hedge(fit, dv01, hedges, (-50.0, 50.0)).table.first().refused is None


def test_walks_are_refused(spark):
    from panelfactor.operators import forecast, panel

    nodes = Nodes(("a", "b", "c"), (1.0, 2.0, 5.0))
    rows = [("p", dt.date(2020, 1, 3) + dt.timedelta(7 * k), float(k % 5), float(k % 3), float(k % 7)) for k in range(30)]
    weekly = panel.weekly_curve(spark.createDataFrame(rows, "panel string, date date, a double, b double, c double"), nodes.names)
    changes = panel.changes(weekly, nodes.names)
    forecast.check_inputs(changes, nodes, 10, weekly)
    for bad, train in ((changes, 29), (changes.where("pos <> 4"), 10), (changes.selectExpr("* except (a)", "if(pos = 3, double('nan'), a) as a"), 10), (changes.drop("a"), 10)):
        with pytest.raises(ValueError):
            forecast.check_inputs(bad, nodes, train)
    with pytest.raises(ValueError, match="levels"):
        forecast.check_inputs(changes.selectExpr("* except (b)", "b + 0.001 as b"), nodes, 10, weekly)


def test_command_line_sources_and_settings(spark, curve, tmp_path, capsys):
    """A live source by an injected fetch, its cache, the dumped settings, and a run without forecasts."""
    at, end = curve
    payload = (at / "curve.csv").read_bytes().replace(b"Date,", b"observation_date,", 1)
    for tenor, series in zip(TREASURY.names, TREASURY.series_ids, strict=True):
        payload = payload.replace(f",{tenor}".encode() + (b"," if tenor != "30Y" else b"\n"), f",{series}".encode() + (b"," if tenor != "30Y" else b"\n"), 1)
    argv = ["--source-mode", "live", "--start", "2015-01-01", "--end", end, "--policy", "include_and_flag", "--cache", str(tmp_path / "cache"), "--maximum-staleness-days", "9000", "--skip-forecast", "--dump-effective-config", str(tmp_path / "in-force.json"), "--output", str(tmp_path / "runs")]
    code = cli.main(argv, spark, fetch=lambda url, timeout: payload)
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    in_force = json.loads((tmp_path / "in-force.json").read_text())
    assert in_force["data"]["maximum_staleness_days"] == 9000 and in_force["forecast"]["enabled"] is False
    # 159 changes are fewer than the default settings ask for: told and logged, not hidden
    assert code == 2 and "Changes" in told["error"] and (tmp_path / "cache").is_dir()


def test_cache_entries_are_locked(tmp_path):
    with panels.locked(str(tmp_path), "k"), pytest.raises(OSError), panels.locked(str(tmp_path), "k", patience=0.2):
        pass


def test_artifacts_say_what_they_hold(tmp_path, spark):
    table = spark.createDataFrame([("a, \"b\"", 1, 2.5, True, dt.date(2020, 1, 1)), (None, None, None, None, None)], "t string, i int, d double, b boolean, day date")
    made = run.Analysis({"x": table}, table.select("t"))
    path, reused = run.write_run(made, str(tmp_path), "id")
    told = run.verify_run(path, "id")["artifacts"]["x.csv"]
    assert not reused and told["rows"] == 2 and told["kinds"] == [["missing", "text"], ["integer", "missing"], ["missing", "number"], ["boolean", "missing"], ["date", "missing"]]
    (tmp_path / "ragged.csv").write_text("a,b\n1\n")
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    for name in ("ragged", "twice"):
        with pytest.raises(ValueError):
            run.contract(str(tmp_path / f"{name}.csv"))
    with pytest.raises(ValueError, match="shared folder"):
        run.write_run(made, str(tmp_path), "small", summary_rows=1)
    path, _ = run.write_run(made, str(tmp_path), "large", summary_rows=1, large_folder=f"file://{tmp_path}/shared")
    large = run.verify_run(path, "large")["large"]
    assert set(large) == {"x", "assessment"} and all(len(p["sha256"]) == 64 for p in large["x"]["parts"])
