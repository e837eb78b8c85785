import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfactor.functions.stats import binomial_at_most, chi2_1_sf, hac_test
from panelfactor.operators import factors, forecast, intervals

from .synthetic import NODES, factor_changes, wide


@pytest.fixture(scope="module")
def values():
    return factor_changes(320, 21, (3.0, 1.5, 0.75), 0.05, (0.85, 0.7, 0.55))


@pytest.fixture(scope="module")
def predictions(spark, values):
    return forecast.walk_forward(wide(spark, values), NODES, 150).persist()


def direct(values, pos, k=3, ridge=1e-3, bound=0.995):
    """The forecasts of one origin from its raw rows."""
    x = values[:pos]
    m = factors.decompose(x.mean(axis=0), np.cov(x.T), factors.shape_templates(NODES.maturities))
    v = np.stack(m["components"])[:k]
    s = (x - x.mean(axis=0)) @ v.T
    ar = []
    for j in range(k):
        slope = np.clip(np.polyfit(s[:-1, j], s[1:, j], 1)[0], -bound, bound)
        ar.append(s[1:, j].mean() + slope * (s[-1, j] - s[:-1, j].mean()))
    sd = s.std(axis=0, ddof=1)
    z = s / sd
    design = np.c_[np.ones(pos - 1), z[:-1]]
    b = np.linalg.solve(design.T @ design + np.diag([0, *[ridge] * k]), design.T @ z[1:])[1:]
    radius = np.abs(np.linalg.eigvals(b)).max()
    b *= min(1, bound / radius)
    var = (z[1:].mean(axis=0) + (z[-1] - z[:-1].mean(axis=0)) @ b) * sd
    return x.mean(axis=0) + np.array(ar) @ v, x.mean(axis=0) + var @ v


def test_origins_equal_direct_fits(predictions, values):
    for pos in (150, 217, 319):
        got = {(r.model, r.node): r.fitted for r in predictions.where(F.col("pos") == pos).collect()}
        for name, want in zip((forecast.AR, forecast.VAR), direct(values, pos), strict=True):
            assert np.allclose([got[name, n] for n in NODES.names], want, atol=1e-8)
        assert got[forecast.NO_CHANGE, "5Y"] == 0 and got[forecast.MEAN, "5Y"] == pytest.approx(values[:pos, NODES.names.index("5Y")].mean())


def test_autoregression_beats_no_change_and_is_adopted(predictions):
    rmse = {r.model: r.rmse for r in forecast.forecast_metrics(predictions).where("node is null").collect()}
    assert rmse[forecast.AR] < 0.9 * rmse[forecast.NO_CHANGE]
    gate = {r.model: r for r in forecast.adoption_gate(predictions, 52, 52).collect()}
    assert gate[forecast.AR].selection_passes and sum(r.selected for r in gate.values()) == 1 and not gate[forecast.NO_CHANGE].selected


def test_later_rows_do_not_change_earlier_forecasts(spark, values, predictions):
    later = values.copy()
    later[250:] += 100
    again = forecast.walk_forward(wide(spark, later), NODES, 150)
    key = ["pos", "model", "node"]
    both = predictions.where("pos <= 249").join(again.select(*key, F.col("fitted").alias("f2")), key)
    assert both.count() == 100 * 36 and both.agg(F.max(F.abs(F.col("fitted") - F.col("f2")))).first()[0] < 1e-9


def test_no_advantage_is_no_test(spark):
    rows = spark.createDataFrame([("a", k, 0.0) for k in range(60)] + [("b", k, 1.0 * k) for k in range(15)], "g string, pos long, v double")
    r = {x.g: x for x in hac_test(rows, ["g"], "pos", "v").collect()}
    assert r["a"].mean == 0 and r["a"].statistic is None and r["b"].mean is None


def test_hac_equals_direct_sums(spark):
    v = np.random.default_rng(3).normal(0.2, 1, 80)
    c = v - v.mean()
    lrv = c @ c / 80 + 2 * sum((1 - k / 5) * (c[k:] @ c[:-k]) / 80 for k in range(1, 5))
    r = hac_test(spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "pos long, v double").withColumn("g", F.lit(1)), ["g"], "pos", "v").first()
    assert r.statistic == pytest.approx(v.mean() / math.sqrt(lrv / 80)) and r.p_value == pytest.approx(math.erfc(abs(r.statistic) / 2**0.5))


def test_tail_probabilities(spark):
    r = spark.createDataFrame([(3.841458820694124, 2, 10, 0.5)], "x double, k long, n long, p double").select(chi2_1_sf("x").alias("c"), binomial_at_most("k", "n", "p").alias("b")).first()
    assert r.c == pytest.approx(0.05) and r.b == pytest.approx(56 / 1024)


def test_coverage_status(predictions):
    gate = forecast.adoption_gate(predictions, 52, 52)
    rows = intervals.selected_residuals(predictions, gate)
    c = intervals.coverage(rows, NODES, 104, 52, 110, replications=200, block_lengths=(4,)).collect()
    assert len(c) == 18 and all(r.n == 60 and r.low <= r.rate <= r.high for r in c)
    none = intervals.coverage(rows, NODES, 104, 500, replications=200, block_lengths=(4,)).collect()
    assert {r.status for r in none} == {"NOT EVALUATED"}


def test_bounds_of_few_draws_decide_nothing(predictions):
    rows = intervals.selected_residuals(predictions, forecast.adoption_gate(predictions, 52, 52))
    few = intervals.coverage(rows, NODES, 104, 52, 110, tolerance=0.5, replications=200, block_lengths=(4,)).collect()
    assert {r.status for r in few} == {"INCONCLUSIVE"} and all(r.low > r.floor and r.tail_order_statistics < 20 for r in few)
    enough = intervals.coverage(rows, NODES, 104, 52, 110, tolerance=0.5, replications=14_400, block_lengths=(4,)).collect()
    assert {r.status for r in enough} == {"PASS"} and all(r.tail_order_statistics >= 20 for r in enough)
