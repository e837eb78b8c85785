"""Spectrum of each panel's changes by a tall-skinny QR tree: a route that never forms a covariance.

The rows of a panel, with a column of ones in front, are factorised where they lie: every Arrow batch leaves one small R
for each of its panels. R factors are stacked and factorised again, pairwise, over two shuffled levels, so a panel of
any length is worked on by all tasks. Below the first row, the last R is that of the centred changes: its singular values and
right vectors are the model's, and the first row holds the means.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PANEL, col
from .factors import per_batch, stacked

#: R factors that meet in one group of the first level.
FAN = 256

_FACTOR = "panel string, leaf long, n long, w1 double, w2 double, r array<double>"


def _merged(factors: np.ndarray) -> np.ndarray:
    """One R of a stack of them, by rounds of pairs."""
    while len(factors) > 1:
        odd = factors[2 * (len(factors) // 2) :]
        pairs = factors[: len(factors) - len(odd)]
        both = pairs.reshape(len(pairs) // 2, -1, factors.shape[2])
        factors = np.concatenate([np.linalg.qr(both, mode="r"), odd])
    return factors[0]


def _square(r: np.ndarray) -> np.ndarray:
    """A triangle with rows of zeros where a batch had fewer rows than columns."""
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _leaves(batches):
    """Rows (panel, leaf, weight, x) in; one factor for each panel of a batch out."""
    for batch in batches:
        panels, code = np.unique(np.array(batch.column(PANEL).to_pylist(), object), return_inverse=True)
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
        w = batch.column("weight").to_numpy(zero_copy_only=False)
        leaf = batch.column("leaf").to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(panels) + 1))
        out = []
        for k, name in enumerate(panels):
            own = order[cuts[k] : cuts[k + 1]]
            root = np.sqrt(w[own])[:, None]
            r = _square(np.linalg.qr(np.hstack([root, x[own] * root]), mode="r"))
            out.append((name, int(leaf[own[0]]), len(own), float(w[own].sum()), float((w[own] ** 2).sum()), r.ravel().tolist()))
        yield _batch(out)


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FACTOR.split(", ")])


def _level(table: pa.Table) -> pa.Table:
    r = table["r"].to_pylist()
    size = int(round(len(r[0]) ** 0.5))
    one = _merged(np.array(r).reshape(len(r), size, size))
    total = [table[c].to_numpy().sum() for c in ("n", "w1", "w2")]
    return pa.Table.from_batches([_batch([(table[PANEL][0].as_py(), table["leaf"][0].as_py(), int(total[0]), float(total[1]), float(total[2]), one.ravel().tolist())])])


def _spectrum(p: int, standardize: bool):
    def run(batch):
        r = stacked(batch["r"], p + 1, p + 1)
        n, w1, w2 = (batch[c].to_numpy(float)[:, None] for c in ("n", "w1", "w2"))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = r[:, 0, 1:] / r[:, :1, 0]
            # sum of weighted squares to sample covariance: n - 1, or w1 (1 - w2 / w1^2) with weights
            below = r[:, 1:, 1:] / np.sqrt(w1 - w2 / w1)[:, :, None]
            deviation = np.linalg.norm(below, axis=1)
            scale = np.where(deviation > 0, deviation, 1) if standardize else np.ones_like(deviation)
        good = np.isfinite(below).all(axis=(1, 2)) & (n[:, 0] > 1)
        _, values, vectors = np.linalg.svd(np.where(good[:, None, None], below / scale[:, None, :], 0))
        told = {"mean": mean, "deviation": deviation, "eigenvalues": values**2}
        out = {k: [list(x) if ok else None for x, ok in zip(v, good, strict=True)] for k, v in told.items()}
        return out | {"vectors": [[list(x) for x in v] if ok else None for v, ok in zip(vectors, good, strict=True)]}

    return run


def spectrum(changes: DataFrame, names, weight: Column | None = None, standardize: bool = False) -> DataFrame:
    """panel, n, mean, deviation, eigenvalues (falling), vectors (rows) of each panel's (weighted) covariance or correlation.

    Rows with a null node take no part. Panels with one row have nulls. Weights may be of any size above zero.
    """
    x = F.array(*(col(n) for n in names))
    whole = F.forall(x, lambda v: v.isNotNull())
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = changes.select(PANEL, x.alias("x"), w.alias("weight"), F.monotonically_increasing_id().alias("leaf")).where(whole & (F.col("weight") > 0))
    leaves = rows.mapInArrow(_leaves, _FACTOR)
    first = leaves.groupBy(PANEL, F.pmod(F.xxhash64("leaf"), F.lit(FAN))).applyInArrow(lambda key, t: _level(t), _FACTOR)
    last = first.groupBy(PANEL).applyInArrow(lambda key, t: _level(t), _FACTOR)
    p = len(names)
    return per_batch(last, _spectrum(p, standardize), [PANEL, "n"], "mean array<double>, deviation array<double>, eigenvalues array<double>, vectors array<array<double>>")


def spectrum_table(made: DataFrame) -> DataFrame:
    """One row for each component: panel, component, eigenvalue, share, cumulative_share."""
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda s, v: s + v)
    rows = made.select(PANEL, total.alias("total"), F.posexplode("eigenvalues").alias("k", "eigenvalue"))
    upto = F.sum("eigenvalue").over(Window.partitionBy(PANEL).orderBy("k"))
    return rows.select(PANEL, (F.col("k") + 1).alias("component"), "eigenvalue", (F.col("eigenvalue") / F.col("total")).alias("share"), (upto / F.col("total")).alias("cumulative_share"))
