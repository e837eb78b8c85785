import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfactor.functions import scan
from panelfactor.operators import factors, forecast, moments, quality, stability, tsqr

from .synthetic import NODES, factor_changes, wide

NAMES = NODES.names


@pytest.fixture(scope="module")
def values():
    return factor_changes()


@pytest.fixture(scope="module")
def changes(spark, values):
    return wide(spark, values).persist()


def test_templates_are_orthonormal_and_signed():
    t = factors.shape_templates(NODES.maturities)
    assert np.allclose(t @ t.T, np.eye(3))
    assert t[0].mean() > 0 and t[1, -1] > t[1, 0] and t[2] @ (-(np.log(NODES.maturities) - np.log(NODES.maturities).mean()) ** 2) > 0
    for bad in ([1, 2], [1, 1, 2], [0, 1, 2], [1, 2, np.nan]):
        with pytest.raises(ValueError):
            factors.shape_templates(bad)


def test_factors_of_a_made_up_panel_are_found(changes, values):
    m = factors.fit(changes, NODES).first()
    assert list(m.suggested) == list(factors.SHAPES) and all(m.identified)
    cov = np.cov(values.T)
    assert np.allclose(np.sort(m.eigenvalues), np.linalg.eigvalsh(cov))
    assert np.allclose(m.center, values.mean(axis=0))
    v = np.array(m.components)
    assert np.allclose(v.T @ np.diag(m.eigenvalues) @ v, cov)
    assert np.allclose(np.abs((v[:3] * factors.shape_templates(NODES.maturities)).sum(axis=1)), 1, atol=0.02)


def test_column_order_does_not_matter(spark, changes):
    order = list(reversed(NAMES))
    a, b = factors.fit(changes, NODES).first(), factors.fit(changes, NODES.subset(order)).first()
    assert np.allclose(a.eigenvalues, b.eigenvalues)
    assert np.allclose(np.array(a.components)[:3], np.array(b.components)[:3, ::-1])


def test_round_trip_and_algebra(changes):
    model = factors.fit(changes, NODES)
    back = factors.reconstruct(changes, model, NODES, len(NAMES))
    assert back.agg(F.max(F.abs(F.col("actual") - F.col("fitted")))).first()[0] < 1e-9
    checks = quality.algebra_checks(changes, model, moments.moments(changes, NAMES), NODES).collect()
    assert len(checks) == 10 and all(r.status == "PASS" for r in checks)
    unit = factors.fit(changes, NODES, standardize=True)
    recent = factors.fit(changes, NODES, halflife=52)
    weighted = moments.moments(changes, NAMES, weight=moments.ewma_weight(52))
    others = quality.algebra_checks(changes, unit, moments.moments(changes, NAMES), NODES, standardized=True).collect(), quality.algebra_checks(changes, recent, weighted, NODES, weight=moments.ewma_weight(52)).collect()
    assert [len(x) for x in others] == [11, 8] and all(r.status == "PASS" for x in others for r in x)


def test_standardized_fit_has_unit_trace(changes):
    m = factors.fit(changes, NODES, standardize=True).first()
    assert sum(m.eigenvalues) == pytest.approx(len(NAMES))


def test_recency_weights(changes, values):
    n, h = len(values), 52.0
    w = 0.5 ** (np.arange(n)[::-1] / h)
    w /= w.sum()
    x = values - w @ values
    want = (x * w[:, None]).T @ x / (1 - w @ w)
    got = moments.moments(changes, NAMES, weight=moments.ewma_weight(h)).first()
    assert np.allclose(np.array(got.cov).reshape(want.shape), want) and got.n_eff == pytest.approx(1 / (w @ w))


def test_constant_node_gives_no_model(spark, values):
    flat = values.copy()
    flat[:, 2] = 1.0
    assert factors.fit(wide(spark, flat), NODES).first().center is None


def test_rotated_pair_is_unidentified(spark):
    rng = np.random.default_rng(404)
    t = factors.shape_templates(NODES.maturities)
    mixed = np.stack([(t[0] + t[1]) / 2**0.5, (t[0] - t[1]) / 2**0.5, t[2]])
    x = rng.normal(0, (20, 8, 3), (800, 3)) @ mixed + rng.normal(0, 0.1, (800, 9))
    m = factors.fit(wide(spark, x), NODES).first()
    assert not m.identified[0] and not m.identified[1] and m.identified[2]
    assert m.labels[0] == "PC1 Unidentified"


def test_a_model_compared_with_itself(changes):
    m = factors.fit(changes, NODES)
    r = factors.regime_table(factors.compare_models(m, m, 3)).collect()
    assert all(x.cosine == pytest.approx(1) and x.principal_angle < 1e-5 and x.sigma_ratio == pytest.approx(1) for x in r)


def test_rolling_windows_equal_direct_fits(changes, values):
    model = factors.fit(changes, NODES)
    rows = {r.window_end: r for r in stability.rolling(changes, model, NODES, 104, step=90).collect()}
    assert sorted(rows) == [104, 194, 284, 374, 400]
    for end, r in rows.items():
        e = np.sort(np.linalg.eigvalsh(np.cov(values[end - 104 : end].T)))[::-1]
        assert r.top_share == pytest.approx(e[:3].sum() / e.sum()) and r.n_obs == 104


def test_sequential_windows_do_not_overlap(changes):
    rows = stability.sequential(changes, NODES, 104, step=50).collect()
    assert {r.window_end for r in rows} == {208, 258, 308, 358, 400}
    assert all(r.r_last_date < r.c_first_date and r.r_n_obs == r.c_n_obs == 104 for r in rows)


def test_vintages_equal_direct_fits_and_do_not_look_ahead(spark, changes, values):
    made = {r.vintage: r for r in stability.vintages(changes, NODES, 104, 50).collect()}
    assert sorted(made) == [0, 1, 2, 3, 4, 5]
    for v, r in made.items():
        assert r.n_obs == 104 + 50 * v
        assert np.allclose(np.sort(r.eigenvalues), np.linalg.eigvalsh(np.cov(values[: 104 + 50 * v].T)), rtol=1e-9)
    oos = stability.oos_reconstruction(changes, NODES, 104, 50)
    assert quality.no_look_ahead(oos).count() == 0 and oos.count() == (400 - 104) * 9
    later = values.copy()
    later[300:] *= 5
    again = stability.oos_reconstruction(wide(spark, later), NODES, 104, 50)
    key = ["pos", "node"]
    both = oos.where("pos < 300").join(again.withColumnRenamed("fitted", "f2").select(*key, "f2"), key)
    assert both.agg(F.max(F.abs(F.col("fitted") - F.col("f2")))).first()[0] < 1e-9


def test_bootstrap_is_the_same_for_any_partitioning(spark, changes):
    model = factors.fit(changes, NODES)
    run = lambda: stability.bootstrap_summary(stability.bootstrap(changes, model, NODES, 40, (4, 13)), 3, 1).orderBy("block_length", "metric").toPandas()
    a = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = run()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (a.replications == 40).all() and np.allclose(a[["low", "median", "high"]], b[["low", "median", "high"]])


def test_regimes_leave_the_spanning_change_out(changes):
    r = stability.regimes(changes, NODES, "2019-01-01", least_rows=52).first()
    assert r.n_before + r.n_after == 399 and r.status == "EVALUATED"
    short = stability.regimes(changes, NODES, "2022-06-01", least_rows=52).collect()
    assert [x.status for x in short] == ["NOT EVALUATED"]


def test_an_empty_panel_gives_no_models(spark, changes):
    assert factors.fit(changes.where("false"), NODES).count() == 0


def test_a_falsified_covariance_fails_the_control(changes, values):
    told = moments.moments(changes, NAMES)
    for column, bad in (("cov", F.transform("cov", lambda v: v * 1.0001)), ("mean", F.transform("mean", lambda v: v + 0.01))):
        wrong = told.withColumn(column, bad)
        model = factors.models(wrong, NODES.maturities)
        status = {r.control: r.status for r in quality.algebra_checks(changes, model, wrong, NODES).collect()}
        assert status["Singular values" if column == "cov" else "Means"] == "FAIL"


@pytest.mark.parametrize("kind", ["plain", "weighted", "correlation"])
def test_spectrum_by_qr_equals_numpy(spark, values, kind, monkeypatch):
    monkeypatch.setattr(tsqr, "FAN", 3)
    own = values[:, :5] * [1, 2, 3, 4, 5]
    table = wide(spark, own, nodes=NODES.subset(NAMES[:5])).unionByName(wide(spark, own[:3], "few", nodes=NODES.subset(NAMES[:5]))).repartition(7)
    weight = moments.ewma_weight(52) if kind == "weighted" else None
    got = {r.panel: r for r in tsqr.spectrum(table, NAMES[:5], weight, kind == "correlation").collect()}
    w = 0.5 ** (np.arange(len(own))[::-1] / 52.0) if weight is not None else np.ones(len(own))
    w = w / w.sum()
    x = own - w @ own
    cov = (x * w[:, None]).T @ x / (1 - w @ w)
    cov = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))) if kind == "correlation" else cov
    values_, vectors = np.linalg.eigh(cov)
    assert np.allclose(got["p"].eigenvalues, values_[::-1], rtol=1e-9) and np.allclose(got["p"].mean, w @ own)
    assert np.allclose(np.abs(np.array(got["p"].vectors) @ vectors[:, ::-1]), np.eye(5), atol=1e-6)
    assert np.allclose(got["few"].eigenvalues[2:], 0, atol=1e-9)


def test_values_far_from_zero_keep_their_digits(spark, monkeypatch):
    """Levels near 10^7 that shift to 10^9 in the middle, with unit spread: every kind of sample against centred sums in long doubles."""
    monkeypatch.setattr(scan, "CHUNK", 37)
    r = np.random.default_rng(12)
    three = NODES.subset(NAMES[:3])
    x = r.normal(size=(300, 3)) + np.where(np.arange(300) < 150, 1e7, 1e9)[:, None]
    table = wide(spark, x, nodes=three).repartition(5)

    def cov(rows, w=None):
        rows = rows.astype(np.longdouble)
        w = np.full(len(rows), 1 / len(rows), np.longdouble) if w is None else w / w.sum()
        d = rows - w @ rows
        return ((d * w[:, None]).T @ d / (1 - w @ w)).astype(float)

    early = table.where("pos < 150").withColumn("n_rows", F.lit(150))
    w = 0.5 ** (np.arange(150)[::-1].astype(np.longdouble) / 52)
    for got, want in ((moments.moments(early, three.names, weight=F.lit(1.0)), cov(x[:150])), (moments.moments(early, three.names, weight=moments.ewma_weight(52)), cov(x[:150], w))):
        assert np.allclose(np.array(got.first()["cov"]).reshape(3, 3), want, rtol=1e-10, atol=1e-10)
    rows = {r.pos: r for r in scan.expanding_moments(table, three.names).collect()}
    for pos in (2, 36, 37, 38, 74, 150, 151, 299):
        n = rows[pos].n_before
        assert n == pos and np.allclose(np.array(rows[pos].m2).reshape(3, 3) / (n - 1), cov(x[:pos]), rtol=1e-9, atol=1e-9)
        long = x[:pos].astype(np.longdouble)
        a, b = long[1:] - long[1:].mean(axis=0), long[:-1] - long[:-1].mean(axis=0)
        assert np.allclose(np.array(rows[pos].cross).reshape(3, 3), (a.T @ b).astype(float), rtol=1e-9, atol=1e-6)
        assert list(rows[pos].x_last) == list(x[pos - 1]) and list(rows[pos].x_first) == list(x[0])
    made = {r.vintage: r for r in stability.vintages(table, three, 60, 45).collect()}
    assert all(m.n_obs == 60 + 45 * v for v, m in made.items())
    for v, m in ((v, made[v]) for v in (0, 1, 2)):  # beyond the shift one eigenvalue is 10^17 times the others
        assert np.allclose(sorted(m.eigenvalues), np.linalg.eigvalsh(cov(x[: 60 + 45 * v])), rtol=1e-8)
    drawn = stability.bootstrap(early, factors.fit(early, three), three, 3, (7,), seed=5).collect()
    assert len(drawn) == 3 and all(abs(r.candidate_sigma[0] - r.reference_sigma[0]) < 1 for r in drawn)


def test_chunks_do_not_change_walks_and_totals(spark, values, monkeypatch):
    table = wide(spark, values[:200])
    key = ["model", "pos", "node"]
    one = forecast.walk_forward(table, NODES, 104).orderBy(*key).toPandas()
    monkeypatch.setattr(scan, "CHUNK", 23)
    two = forecast.walk_forward(table, NODES, 104).orderBy(*key).toPandas()
    assert np.allclose(one.fitted, two.fitted, rtol=1e-9, atol=1e-10)
    totals = scan.running_totals(table, ["panel"], "pos", {"a": F.col(f"`{NAMES[0]}`")}).orderBy("pos").toPandas()
    assert np.allclose(totals.a, np.cumsum(values[:200, 0]))


def test_references_of_another_specification_are_refused(changes):
    unit, recent = factors.fit(changes, NODES, standardize=True), factors.fit(changes, NODES, halflife=52)
    for reference in (unit, recent):
        with pytest.raises(ValueError, match="reference"):
            stability.rolling(changes, reference, NODES, 104)
        with pytest.raises(ValueError, match="reference"):
            stability.bootstrap(changes, reference, NODES, 5, (13,))
    assert stability.rolling(changes, unit, NODES, 104, step=200, standardize=True).count() == 3


def test_extended_curves_need_days_and_changes(spark):
    import datetime as dt

    from panelfactor.schema import TREASURY

    rng = np.random.default_rng(1)
    rows = [(name, dt.date(2015, 1, 2) + dt.timedelta(7 * k), *map(float, rng.normal(size=11))) for name, n in (("p", 70), ("q", 55), ("r", 61)) for k in range(n)]
    daily = spark.createDataFrame(rows, "panel string, date date, " + ", ".join(f"`{n}` double" for n in TREASURY.names))
    told = {(r.panel, r.curve): r for r in stability.extended_specifications(daily, NODES, TREASURY, "FRI", "include_and_flag", "2015-01-01", "2017-01-01").collect()}
    assert set(told) == {(p, c) for p in ("p", "r") for c in ("core", "extended")}
    x = np.diff(np.array([r[2:] for r in rows if r[0] == "p"]), axis=0) * 100
    for curve, at in (("core", slice(1, 10)), ("extended", slice(0, 11))):
        e = np.sort(np.linalg.eigvalsh(np.cov(x[:, at].T)))[::-1]
        assert told["p", curve].n_obs == 69 and told["p", curve].top_share == pytest.approx(e[:3].sum() / e.sum())
