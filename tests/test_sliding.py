import time

import numpy as np
import pytest

from panelfactor.functions import sliding

ROWS = "panel string, node string, row long, day date, v double"


def table(spark, groups):
    import datetime as dt

    rows = [("p", name, k, dt.date(2000, 1, 1) + dt.timedelta(k), v) for name, values in groups.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.mark.parametrize(("window", "chunk"), [(1, 4), (7, 10), (30, 8), (500, 16)])
def test_quantiles_and_ranks_equal_sorted_windows(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(sliding, "CHUNK", chunk)
    r = np.random.default_rng(window)
    groups = {"a": [float(x) for x in r.normal(size=90)], "b": [float(x) for x in r.integers(0, 3, 61)], "c": [None if k % 4 == 0 else float(k % 7) for k in range(50)], "d": [2.0]}
    points = [0.025, 0.5, 0.9]
    got = {(x.node, x.row): x for x in sliding.sliding_quantiles(table(spark, groups), ["panel", "node"], "row", "v", window, points).collect()}
    assert len(got) == sum(map(len, groups.values()))
    for (node, row), x in got.items():
        known = [v for v in groups[node][max(0, row - window) : row] if v is not None]
        assert x.q == pytest.approx(np.quantile(known, points)) if known else x.q is None
    ranks = sliding.sliding_ranks(table(spark, groups), ["panel", "node"], "row", "v", window, [1, max(1, window - 1)], carried=["day"]).collect()
    for x in ranks:
        before = groups[x.node][max(0, x.row - window) : x.row]
        whole = len(before) == window and None not in before
        assert x.q == ([sorted(before)[0], sorted(before)[max(1, window - 1) - 1]] if whole else None)
        assert (x.day_last is None) == (x.row == 0) and (x.row == 0 or (x.day - x.day_first).days == min(window, x.row))


def test_time_does_not_follow_the_window():
    values = np.random.default_rng(1).normal(size=40_000)

    def seconds(window):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            sliding._slide(values, window, 0, lambda kept: kept[-1] if kept else None)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(520) < 1.5 * seconds(104) and seconds(5_200) < 6 * seconds(104)


def test_resampled_sums_equal_drawn_rows(spark, monkeypatch):
    """Every replication against the rows that its blocks draw, wrapped and cut; chunks of running totals don't matter."""
    from pyspark.sql import functions as F

    from panelfactor.functions import resample, scan

    monkeypatch.setattr(scan, "CHUNK", 9)
    r = np.random.default_rng(2)
    sizes = {"p": 31, "q": 5}
    values = {name: r.normal(size=(n, 2)) for name, n in sizes.items()}
    rows = [(name, k, sizes[name], float(v[0]), None if k == 3 else float(v[1])) for name in sizes for k, v in enumerate(values[name])]
    table = spark.createDataFrame(rows, "panel string, pos long, n long, a double, b double").repartition(3)
    got = {(x.panel, x.block_length, x.replication): x for x in resample.resampled_sums(table, "pos", "n", [F.col("a"), F.col("b")], (2, 7), 11, 5, date=None).collect()}
    blocks = resample.block_starts(table.select("panel", "n").distinct(), (2, 7), 11, 5).collect()
    drawn = {}
    for x in blocks:
        drawn.setdefault((x.panel, x.block_length, x.replication), []).extend((x.start + k) % x.n for k in range(x.length))
    assert set(got) == set(drawn) and len(got) == 44
    for key, at in drawn.items():
        own = values[key[0]].copy()
        own[3, 1] = 0.0
        assert len(at) == sizes[key[0]] == got[key].n
        assert np.allclose(got[key].sums, own[at].sum(axis=0))
