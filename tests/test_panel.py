import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelfactor import config as cfg
from panelfactor.operators import panel, quality
from panelfactor.schema import TREASURY, TREASURY_CORE, Nodes
from panelfactor.sources import live, panels, positions

THREE = Nodes(("a", "b", "c"), (1.0, 2.0, 3.0))


def csv_panel(spark, header, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in header))


@pytest.mark.parametrize("anchor", panel.WEEKDAYS)
def test_period_ends_are_the_next_anchor(spark, anchor):
    days = spark.range(400).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for r in days.select("d", panel.period_end(F.col("d"), anchor).alias("e")).collect():
        assert 0 <= (r.e - r.d).days <= 6 and r.e.weekday() == panel.WEEKDAYS.index(anchor)


def test_last_complete_day_wins_over_later_values(spark):
    rows = [("p", dt.date(2024, 1, 3), 1.0, 1.0, 1.0), ("p", dt.date(2024, 1, 4), 2.0, 2.0, 2.0), ("p", dt.date(2024, 1, 5), 9.0, None, 9.0), ("p", dt.date(2024, 1, 12), 2.01, 2.0, 2.0)]
    weekly = panel.weekly_curve(spark.createDataFrame(rows, "panel string, date date, a double, b double, c double"), THREE.names)
    c = panel.changes(weekly, THREE.names).collect()
    assert len(c) == 1 and c[0].a == pytest.approx(1.0) and c[0].gap_days == 8 and c[0].pos == 0 and c[0].n_rows == 1
    assert weekly.where("date = '2024-01-04'").count() == 1


def test_boundary_weeks(spark):
    rows = [("p", dt.date(2024, 1, d), 1.0, 1.0, 1.0) for d in (3, 10, 17)]
    daily = spark.createDataFrame(rows, "panel string, date date, a double, b double, c double")
    kept = panel.weekly_curve(daily, THREE.names, "FRI", "drop", "2024-01-02", "2024-01-18")
    assert [r.date.day for r in kept.orderBy("date").collect()] == [10]
    assert panel.weekly_curve(daily, THREE.names, "FRI", "include_and_flag").count() == 3
    with pytest.raises(ValueError):
        panel.weekly_curve(daily, THREE.names, policy="pad")


def test_panels_do_not_mix(spark):
    rows = [(p, dt.date(2024, 1, 5) + dt.timedelta(7 * k), float(k * m), 1.0, 1.0) for p, m in (("x", 1), ("y", 10)) for k in range(3)]
    c = panel.changes(panel.weekly_curve(spark.createDataFrame(rows, "panel string, date date, a double, b double, c double"), THREE.names), THREE.names)
    assert {(r.panel, r.a) for r in c.collect()} == {("x", 100.0), ("y", 1000.0)} and quality.positions_are_dense(c).count() == 0


def test_bad_tokens_dates_and_repeats_are_refused(spark):
    good = [("2024-01-05", "1", ".", ""), ("2024-01-12", " 2 ", None, "3")]
    typed, defects = panel.parse_panel(csv_panel(spark, ["Date", "a", "b", "c"], good), THREE, "2024-01-01", "2024-12-31")
    panel.refuse_defects(defects)
    assert [(r.a, r.b, r.c) for r in typed.orderBy("date").collect()] == [(1.0, None, None), (2.0, None, 3.0)]
    bad = [("2024-01-05", "n/a", "1", "1"), ("2024-01-05", "1", "inf", "1"), ("x", "1", "1", "1")]
    _, defects = panel.parse_panel(csv_panel(spark, ["Date", "a", "b", "c"], bad), THREE, "2024-01-01", "2024-12-31")
    assert {(r.kind, r.detail) for r in defects.collect()} == {("token", "n/a"), ("token", "inf"), ("repeated date", "2024-01-05"), ("date", "x")}
    with pytest.raises(ValueError, match="defects"):
        panel.refuse_defects(defects)


def test_headers(spark):
    nodes = Nodes(THREE.names, THREE.maturities, ("A1", "B1", "C1"))
    ids = csv_panel(spark, ["DATE", "A1", "B1", "C1", "extra"], [("2024-01-05", "1", "2", "3", "z")])
    assert panel.parse_panel(ids, nodes, "2024-01-01", "2024-12-31")[0].columns == ["panel", "date", "a", "b", "c"]
    for header in (["DATE", "A1", "b", "c"], ["DATE", "a", "b"], ["DATE", "Date", "a", "b", "c"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            panel.parse_panel(csv_panel(spark, header, [tuple("1" for _ in header)]), nodes, "2024-01-01", "2024-12-31")


def test_quality_checks_fail_closed(spark):
    rows = [("p", dt.date(2024, 1, 5) + dt.timedelta(7 * k), 1.0 + k % 3, 2.0, 3.0 + k % 2) for k in range(60)]
    daily = spark.createDataFrame(rows, "panel string, date date, a double, b double, c double")
    weekly = panel.weekly_curve(daily, THREE.names)
    settings = cfg.DataConfig(start_date="2024-01-01", end_date="2025-02-28", minimum_complete_weeks=52)
    m = quality.quality_metrics(daily, weekly, panel.changes(weekly, THREE.names), THREE, THREE.names, policy="include_and_flag", start="2024-01-01", end="2025-02-28")
    checks = {r.control: r for r in quality.quality_checks(m, settings, as_of="2025-03-01").collect()}
    still, gap = checks["Nodes that never move"], checks["Longest gap in days"]
    assert still.status == "FAIL" and still.figure == 1 and still.measured_on == "changes" and gap.status == "PASS" and gap.figure == 7
    assert checks["Vintages kept"].status == "WARN" and {r.measured_on for r in checks.values()} == {"daily", "weekly", "changes", "request", "source"}
    with pytest.raises(ValueError, match="Nodes that never move"):
        quality.refuse_failures(quality.quality_checks(m, settings, as_of="2025-03-01"))
    stale = quality.quality_checks(m, cfg.DataConfig(maximum_staleness_days=3), as_of="2025-03-01").where("control = 'Age in days'").first()
    assert stale.status == "FAIL"


@pytest.mark.parametrize(("kind", "bad"), [
    (cfg.DataConfig, {"start_date": "2026-01-01"}), (cfg.DataConfig, {"weekly_rule": "FRI"}), (cfg.DataConfig, {"core_tenors": ["3M", "6M", "1Y"]}), (cfg.DataConfig, {"core_tenors": ("3M", "6M")}), (cfg.DataConfig, {"retries": True}), (cfg.DataConfig, {"use_cache": 1}), (cfg.DataConfig, {"maximum_calendar_gap_days": 6}),
    (cfg.FactorConfig, {"retained_factors": 4}), (cfg.FactorConfig, {"minimum_template_similarity": 0}), (cfg.FactorConfig, {"rolling_window_years": 2, "minimum_rolling_observations": 105}), (cfg.FactorConfig, {"bootstrap_sensitivity_blocks": [4]}), (cfg.FactorConfig, {"bootstrap_replications": 799}), (cfg.FactorConfig, {"current_halflife_weeks": float("nan")}),
    (cfg.ForecastConfig, {"ar_coefficient_bound": 1}), (cfg.ForecastConfig, {"interval_bootstrap_replications": 500}), (cfg.ForecastConfig, {"interval_evaluation_observations": 30}), (cfg.ForecastConfig, {"hac_lags": 30}), (cfg.ForecastConfig, {"minimum_interval_observations": 300}),
    (cfg.RiskConfig, {"var_confidence": 0.999}), (cfg.RiskConfig, {"factor_sigma_multiples": (1, 1)}), (cfg.RiskConfig, {"es_confidence": 0.5}),
])
def test_settings_out_of_range(kind, bad):
    with pytest.raises(ValueError):
        kind(**bad)


def test_configuration_files(tmp_path):
    good = tmp_path / "a.json"
    good.write_text('{"forecast": {"interval_bootstrap_block_lengths": [4, 13]}, "data": {}}')
    made = cfg.load_config(str(good), "2024-06-30")
    assert made.forecast.interval_bootstrap_block_lengths == (4, 13) and made.data.end_date == "2025-12-31" and made.forecast.required_rows == 520 + 104 + 260
    # a live source ends today and may not be older than a week, unless the file tells its end
    good.write_text('{"data": {"source_mode": "live"}}')
    made = cfg.load_config(str(good), "2024-06-30").data
    assert (made.end_date, made.maximum_staleness_days) == ("2024-06-30", 7)
    good.write_text('{"data": {"source_mode": "live", "end_date": "2024-01-31"}}')
    made = cfg.load_config(str(good), "2024-06-30").data
    assert (made.end_date, made.maximum_staleness_days) == ("2024-01-31", None)
    # sections and settings by their public names
    names = ["weekly_rule", "core_tenors", "retries", "snapshot_path", "manifest_path", "cache_dir"]
    good.write_text(json.dumps({"data": {"weekly_rule": "W-WED", "retries": 3, "core_tenors": ["2Y", "5Y", "10Y"]}, "pca": {"bootstrap_block_weeks": 4, "oos_refit_every_observations": 5, "minimum_ewma_effective_observations": 90}, "forecast": {"enabled": False, "level_change_reconciliation_tolerance_bp": 1e-7}, "risk": {"minimum_var_backtest_observations": 200}}))
    made = cfg.load_config(str(good))
    assert made.data.anchor == "WED" and made.pca.bootstrap_block_weeks == 4 and not made.forecast.enabled and all(hasattr(made.data, n) for n in names)
    for text in ('{"data": {}, "data": {}}', '{"other": {}}', '{"risk": {"x": 1}}', "[]"):
        good.write_text(text)
        with pytest.raises(ValueError):
            cfg.load_config(str(good))


def snapshot(folder, weeks=80):
    lines = ["observation_date," + ",".join(TREASURY.series_ids)]
    first = dt.date(2020, 1, 3)
    lines += [f"{first + dt.timedelta(7 * k)}," + ",".join(f"{1 + j / 10 + (k * (j + 3)) % 17 / 10:.2f}" for j in range(11)) for k in range(weeks)]
    raw = ("\n".join(lines) + "\n").encode()
    packed = gzip.compress(raw, mtime=0)
    (folder / "s.csv.gz").write_bytes(packed)
    m = {"compressed_bytes": len(packed), "compressed_sha256": hashlib.sha256(packed).hexdigest(), "uncompressed_bytes": len(raw), "uncompressed_sha256": hashlib.sha256(raw).hexdigest(), "columns": 12}
    m |= {"units": "percent_per_annum", "series_ids": list(TREASURY.series_ids), "snapshot_created_at_utc": "2024-01-01T00:00:00+00:00", "rows_excluding_header": weeks, "first_date": str(first), "last_date": str(first + dt.timedelta(7 * (weeks - 1)))}
    (folder / "m.json").write_text(json.dumps(m))
    return (str(folder / "s.csv.gz"), str(folder / "m.json")), raw, m


def test_snapshots_are_verified(spark, tmp_path):
    paths, _, m = snapshot(tmp_path)
    rows, p = panels.read_snapshot(spark, *paths, TREASURY, cfg.DataConfig())
    assert rows.count() == 80 and p.mode == "SNAPSHOT" and len(panel.complete(rows, TREASURY_CORE.names).collect()) == 80
    for change in ({"rows_excluding_header": 79}, {"compressed_sha256": "0" * 64}, {"units": "decimal"}, {"snapshot_created_at_utc": "2024-01-01T00:00:00"}, {"uncompressed_bytes": 5}, {"uncompressed_sha256": "0" * 64}, {"columns": 11}):
        (tmp_path / "m.json").write_text(json.dumps(m | change))
        with pytest.raises(ValueError):
            panels.read_snapshot(spark, *paths, TREASURY, cfg.DataConfig())


def test_manifests_are_complete_and_unpacking_is_bounded(spark, tmp_path):
    paths, raw, m = snapshot(tmp_path)
    assert panels.unpacked_digest(spark, paths[0], 10**6) == (len(raw), hashlib.sha256(raw).hexdigest(), 12)
    with pytest.raises(ValueError, match="more than"):
        panels.unpacked_digest(spark, paths[0], 100)
    (tmp_path / "m.json").write_text(json.dumps({k: v for k, v in m.items() if k != "uncompressed_sha256"}))
    with pytest.raises(ValueError, match="lacks"):
        panels.read_snapshot(spark, *paths, TREASURY, cfg.DataConfig())


def test_snapshots_are_resolved(spark, tmp_path, monkeypatch):
    """The settings' files from a root; a package's own only where both settings are the defaults and the files are absent."""
    paths, *_ = snapshot(tmp_path)
    told = cfg.DataConfig(snapshot_path="s.csv.gz", manifest_path="m.json")
    assert panels.resolve_snapshot(told, str(tmp_path)) == paths
    brought = tmp_path / "brought_snapshot"
    brought.mkdir()
    (brought / "__init__.py").write_text("")
    monkeypatch.syspath_prepend(str(tmp_path))
    default = cfg.DataConfig()
    with pytest.raises(FileNotFoundError):
        panels.resolve_snapshot(default, str(tmp_path), "brought_snapshot")
    for setting in ("snapshot_path", "manifest_path"):
        (brought / getattr(default, setting).rsplit("/", 1)[1]).write_bytes(b"x")
    assert panels.resolve_snapshot(default, str(tmp_path), "brought_snapshot")[0].startswith(str(brought))
    with pytest.raises(FileNotFoundError):
        panels.resolve_snapshot(cfg.DataConfig(manifest_path="other.json"), str(tmp_path), "brought_snapshot")


def test_live_cache_and_fallback(spark, tmp_path):
    paths, raw, _ = snapshot(tmp_path)
    asked = tmp_path / "asked"  # workers ask: a file tells how often

    def up(url, timeout):
        with open(asked, "a") as f:
            f.write(url + "\n")
        return raw

    def down(url, timeout):
        with open(asked, "a") as f:
            f.write("down\n")
        raise OSError("no network")

    live = cfg.DataConfig(source_mode="live_then_snapshot", start_date="2020-01-01", end_date="2021-07-10", minimum_complete_weeks=52)
    folder = str(tmp_path / "cache")
    read = lambda fetch, c=live, f=folder: panels.read_source(spark, c, TREASURY, paths, fetch, f, sleep=lambda s: None)[1]
    assert read(down).mode == "SNAPSHOT_FALLBACK" and asked.read_text().count("down") == 2
    p = read(up)
    assert p.mode == "LIVE_FRED" and p.rows == 80 and read(down).mode == "LOCAL_CACHE"
    assert "cosd=2020-01-01&coed=2021-07-10" in asked.read_text()
    # quality is judged again: what passed may not pass now
    strict = cfg.DataConfig(source_mode="live_then_snapshot", start_date="2020-01-01", end_date="2021-07-10")
    assert read(down, strict).mode == "SNAPSHOT_FALLBACK"
    kept = next(tmp_path.glob("cache/*.csv"))
    kept.write_bytes(b"changed")
    assert read(down).mode == "SNAPSHOT_FALLBACK"
    # a whole entry that is no panel is a miss too
    panels.write_cache(folder, kept.stem, b"observation_date,DGS2\nx", panels.datetime.now(panels.timezone.utc).isoformat())
    assert read(up).mode == "LIVE_FRED"
    blocked = tmp_path / "file"
    blocked.write_text("")
    assert read(up, live, str(blocked)).mode == "LIVE_FRED_NO_CACHE"
    with pytest.raises(panels.PayloadInvalid):
        read(lambda *_: b"<html>", live, str(tmp_path / "other"))
    with pytest.raises(panels.SourceUnavailable):
        read(down, cfg.DataConfig(source_mode="live"), str(tmp_path / "none"))


def test_live_source_reads_ranges_of_dates(spark):
    """As a format of its own: a partition for each range, the same rows as one request, size limits, both kinds of failure."""
    days = [str(dt.date(2001, 1, 5) + dt.timedelta(7 * k)) for k in range(300)]

    def fetch(url, timeout):
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(url).query)
        own = [d for d in days if q["cosd"][0] <= d <= q["coed"][0]]
        return ("observation_date,B,A\n" + "".join(f"{d},{d[-2:]},.\n" for d in own)).encode()

    def load(fetch, **options):
        spark.dataSource.register(live.live_source(fetch, lambda s: None))
        return spark.read.format("panel_live").options(ids="A,B", start="2001-01-01", end="2006-12-31", **options).load()

    whole, cut = load(fetch), load(fetch, years="2")
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() == 3
    rows = sorted(map(tuple, cut.collect()))
    assert rows == sorted(map(tuple, whole.collect())) == [(d, ".", d[-2:]) for d in days]
    ranges = live.date_ranges("2001-05-05", "2004-02-01", 2)
    assert [(r.start, r.end) for r in ranges] == [("2001-05-05", "2002-12-31"), ("2003-01-01", "2004-02-01")]
    for bad, word in ((lambda u, t: b"<html>", live.INVALID), (lambda u, t: b"DATE,A\n2001-01-01,1\n", live.INVALID), (lambda u, t: b"DATE,A,B\n2001-01-01,1\n", live.INVALID)):
        with pytest.raises(Exception, match=word):
            load(bad).collect()
    with pytest.raises(Exception, match=live.INVALID):
        load(fetch, maximum_bytes="100").collect()
    with pytest.raises(Exception, match=live.UNAVAILABLE):
        load(lambda u, t: (_ for _ in ()).throw(OSError("down"))).collect()


def test_positions(spark, tmp_path):
    at = tmp_path / "krd.csv"
    at.write_text("tenor,dv01_usd_per_bp\n" + "\n".join(f"{n},{k}" for k, n in enumerate(TREASURY_CORE.names)))
    table, sha = positions.read_dv01(spark, str(at), TREASURY_CORE)
    assert table.count() == 9 and sha == hashlib.sha256(at.read_bytes()).hexdigest()
    for text in ("tenor,dv01\n3M,1", "tenor,dv01_usd_per_bp\n3M,1\n3M,2", "tenor,dv01_usd_per_bp\n" + "\n".join(f"{n},x" for n in TREASURY_CORE.names)):
        at.write_text(text)
        with pytest.raises(ValueError):
            positions.read_dv01(spark, str(at), TREASURY_CORE)
    said = dict.fromkeys(positions.METADATA, "id-1") | {"valuation_date": "2024-01-05", "currency": "USD", "bump_bp": 1.0, "sign_convention": positions.SIGN, "curve_id": "ust"}
    positions.check_metadata(said, True, "ust", dt.date(2024, 1, 5))
    for change in ({"currency": "EUR"}, {"bump_bp": 10}, {"portfolio_id": ""}, {"valuation_date": "2024-01-06"}, {"curve_id": "other"}):
        with pytest.raises(ValueError):
            positions.check_metadata(said | change, True, "ust", dt.date(2024, 1, 5))
    with pytest.raises(ValueError):
        positions.check_metadata(None, True, "ust", dt.date(2024, 1, 5))
