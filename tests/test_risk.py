import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfactor.operators import factors, risk

from .synthetic import NODES, factor_changes, wide

DV01 = (0.0, 0.0, 25e3, 100e3, 150e3, 200e3, 150e3, 100e3, 50e3)


@pytest.fixture(scope="module")
def values():
    return factor_changes(400, 5)


@pytest.fixture(scope="module")
def book(spark, values):
    changes = wide(spark, values).persist()
    return changes, risk.same_for_all(changes, NODES, DV01), factors.fit(changes, NODES).persist()


def series(spark, pnl):
    return spark.createDataFrame([("p", dt.date(2000, 1, 7) + dt.timedelta(7 * k), k, len(pnl), 7, float(v)) for k, v in enumerate(pnl)], "panel string, date date, pos long, n_rows long, gap_days int, pnl double")


def test_attribution_adds_up(book, values):
    changes, dv01, model = book
    rows = risk.factor_pnl(changes, dv01, model, NODES).groupBy("pos").agg(F.sum(F.when(F.col("source") != "Full", F.col("pnl"))).alias("parts"), F.max(F.when(F.col("source") == "Full", F.col("pnl"))).alias("full")).orderBy("pos").toPandas()
    assert np.allclose(rows.parts, rows.full) and np.allclose(rows.full, -values @ np.array(DV01))
    none_left = risk.factor_pnl(changes, dv01, model, NODES, 9).where("source = 'Residual'").agg(F.max(F.abs("pnl"))).first()[0]
    assert none_left < 1e-5


def test_tails_of_small_samples(spark):
    r = {x.measure: x for x in risk.tail_summary(series(spark, -np.arange(104.0)), None).collect()}
    mass = 104 * 0.025
    assert r["ES"].loss == pytest.approx((103 + 102 + (mass - 2) * 101) / mass)
    assert r["VaR"].rank == 104 and r["VaR"].loss == 103 and r["ES"].status == "BELOW REVIEW LEVEL"
    ramp = {x.measure: x for x in risk.tail_summary(series(spark, -np.arange(520.0)), None).collect()}
    assert ramp["VaR"].rank == 516 and ramp["VaR"].loss == 515
    assert risk.tail_summary(series(spark, np.arange(51.0)), None).count() == 0


@pytest.mark.parametrize("kind", ["none", "all", "clustered"])
def test_backtests_of_extreme_series(spark, kind):
    pnl = np.zeros(404)
    if kind == "all":
        pnl = -np.arange(404.0)
    if kind == "clustered":
        pnl[300:320] = -np.arange(1, 21.0)
    detail = risk.backtest_detail(series(spark, pnl), 104)
    s = risk.backtest_summary(detail, 104).first()
    assert s.n == 300 and s.exceptions == {"none": 0, "all": 300, "clustered": 20}[kind]
    assert s.status == ("PASS" if kind == "none" and s.kupiec_p >= 0.05 else "WARN") and s.independence_lr >= 0
    assert detail.where("estimation_end >= date").count() == 0


def test_unattainable_confidence_is_not_evaluated(spark):
    s = risk.backtest_summary(risk.backtest_detail(series(spark, np.random.default_rng(1).normal(size=400)), 60), 60).first()
    assert s.status == "NOT EVALUATED" and s.kupiec_lr is None and not s.attainable


def test_worst_rows_break_ties_by_date(spark):
    x = np.ones((60, 9)) * np.tile([1.0, -1.0], 30)[:, None]
    x[10] = x[20] = 5.0
    changes = wide(spark, x)
    rows = risk.worst_scenarios(changes, risk.same_for_all(changes, NODES, DV01), NODES, 3).orderBy("place").collect()
    assert [r.date for r in rows[:2]] == [dt.date(2015, 1, 2) + dt.timedelta(7 * k) for k in (10, 20)] and rows[0].horizon_days == 7


def test_variance_reconciles(book, values):
    changes, dv01, model = book
    rows = {r.source: r for r in risk.variance_table(model, dv01, NODES).collect()}
    d = np.array(DV01)
    assert rows["Total"].variance == pytest.approx(d @ np.cov(values.T) @ d) and all(r.reconciled for r in rows.values())
    assert sum(r.share for s, r in rows.items() if s != "Total") == pytest.approx(1)


def test_scenarios_mirror(book):
    _, dv01, model = book
    rows = {(r.factor, r.multiple): r.pnl for r in risk.factor_scenarios(model, dv01, NODES).collect()}
    assert len(rows) == 18 and all(v == pytest.approx(-rows[f, -m]) for (f, m), v in rows.items())


def test_defects_of_sensitivities(spark, book):
    changes, dv01, _ = book
    assert risk.dv01_defects(dv01, changes, NODES).count() == 0
    bad = dv01.where("node <> '5Y'").unionByName(spark.createDataFrame([("p", "9Y", 1.0), ("p", "2Y", float("nan"))], "panel string, node string, dv01 double"))
    assert {(r.node, r.defect) for r in risk.dv01_defects(bad, changes, NODES).collect()} == {("5Y", "absent"), ("9Y", "unknown"), ("2Y", "repeated"), ("2Y", "not finite")}


def instruments(spark, rows):
    return spark.createDataFrame([("p", name, n, float(v)) for name, row in rows.items() for n, v in zip(NODES.names, row, strict=True)], "panel string, instrument string, node string, dv01 double")


def test_hedge_meets_its_optimality_conditions(spark, book, values):
    changes, dv01, model = book
    eye = np.eye(9) * 1000
    r = risk.hedge(model, dv01, instruments(spark, {f"h{k}": eye[k] for k in (3, 5, 8)}), NODES, (-120.0, 120.0), 120.0, ridge=0.0).first()
    cov, d, h = np.cov(values.T), np.array(DV01), eye[[3, 5, 8]]
    q = np.array(r.quantities)
    g = h @ cov @ (d + h.T @ q)
    inside = np.abs(q) < 120 - 1e-9
    assert np.all(np.abs(g[inside]) < 1e-6 * np.abs(h @ cov @ d).max()) and np.all(g[q >= 120 - 1e-9] <= 0) and np.all(g[q <= -120 + 1e-9] >= 0)
    assert 0 < r.reduction <= 1 and r.refused is None


def test_hedges_are_refused(spark, book):
    changes, dv01, model = book
    same = {"a": np.eye(9)[3] * 1000, "b": np.eye(9)[3] * 1000}
    assert "redundant" in risk.hedge(model, dv01, instruments(spark, same), NODES, (-9.0, 9.0), 9.0).first().refused
    tiny = {"a": np.eye(9)[3] * 1e-9}
    assert "floor" in risk.hedge(model, dv01, instruments(spark, tiny), NODES, (-9.0, 9.0), 9.0).first().refused


def test_instruments_are_read_strictly(spark, tmp_path):
    from panelfactor.sources import positions

    at = tmp_path / "hedges.csv"
    at.write_text("instrument,tenor,dv01_usd_per_bp\na,2Y,100\na,10Y,-5.5\n b ,5Y,7\n")
    told = {(r.instrument, r.node): r.dv01 for r in positions.read_instruments(spark, str(at), NODES).collect()}
    assert len(told) == 18 and told["a", "2Y"] == 100 and told["a", "10Y"] == -5.5 and told["b", "5Y"] == 7 and told["b", "2Y"] == 0
    for bad in ("instrument,tenor,dv01\na,2Y,1\n", "instrument,tenor,dv01_usd_per_bp\na,2Y,x\n", "instrument,tenor,dv01_usd_per_bp\na,2Y,1\na,2Y,2\n", "instrument,tenor,dv01_usd_per_bp\na,9Y,1\n", "instrument,tenor,dv01_usd_per_bp\n,2Y,1\n"):
        at.write_text(bad)
        with pytest.raises(ValueError):
            positions.read_instruments(spark, str(at), NODES)
