"""Means and covariances of nodes, made by Spark's aggregates; a panel's moments are one small row.

All factor operators start from these rows: windows, vintages and resamples are other groupings of
the same centred moments, so no operator fits a model on raw rows, and values far from zero lose no digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, PANEL, POS, col


def ewma_weight(halflife: float, pos: Column | None = None, n: Column | None = None) -> Column:
    """Weight 0.5 ** (age / halflife), age 0 for a panel's newest row (not normalised)."""
    if halflife <= 1:
        raise ValueError("halflife must be above one")
    return F.pow(F.lit(0.5), ((F.col("n_rows") if n is None else n) - 1 - (F.col(POS) if pos is None else pos)) / F.lit(float(halflife)))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(p: int, cell) -> Column:
    """Row-major p x p array of ``cell(i, j)``, i <= j."""
    return F.array(*(cell(min(i, j), max(i, j)) for i in range(p) for j in range(p)))


def moments(rows: DataFrame, nodes, keys=(PANEL,), weight: Column | None = None) -> DataFrame:
    """keys, n_obs, n_eff, first_date, last_date, mean (array), cov (row-major array).

    Without ``weight``: sample moments. With weights w (normalised here): centre w.x and divide by
    1 - sum(w^2); n_eff is 1 / sum(w^2). Both are made of deviations: Spark's covariance merges centred
    co-moments; weighted ones take the weighted means first (a row for each key) and then the rows' distances from them.
    """
    p, keys = len(nodes), list(keys)
    if weight is None:
        sums = [F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(nodes)] + [F.covar_samp(col(nodes[i]), col(nodes[j])).alias(f"c{i}_{j}") for i, j in _pairs(p)]
        g = rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.count("*").cast("double").alias("n_eff"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), *sums)
        mean, cov = (lambda i: F.col(f"m{i}")), (lambda i, j: F.col(f"c{i}_{j}"))
    else:
        w = rows.select(*keys, DATE, *(col(n).alias(f"x{i}") for i, n in enumerate(nodes)), weight.cast("double").alias("_w"))
        # the plain mean is near enough to the weighted one for its rounding not to count
        pilot = w.groupBy(*keys).agg(*(F.avg(f"x{i}").alias(f"a{i}") for i in range(p)))
        near = w.join(pilot, keys).select(*keys, "_w", *(F.col(f"a{i}") for i in range(p)), *((F.col(f"x{i}") - F.col(f"a{i}")).alias(f"d{i}") for i in range(p)))
        centre = near.groupBy(*keys).agg(F.sum("_w").alias("w1"), *((F.first(f"a{i}") + F.sum(F.col("_w") * F.col(f"d{i}")) / F.sum("_w")).alias(f"m{i}") for i in range(p)))
        far = w.join(centre, keys)
        d = lambda i: F.col(f"x{i}") - F.col(f"m{i}")
        g = far.groupBy(*keys).agg(
            F.count("*").alias("n_obs"), F.first("w1").alias("w1"), F.sum(F.col("_w") * F.col("_w")).alias("w2"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
            *(F.first(f"m{i}").alias(f"m{i}") for i in range(p)), *(F.sum(F.col("_w") * d(i)).alias(f"r{i}") for i in range(p)), *(F.sum(F.col("_w") * d(i) * d(j)).alias(f"c{i}_{j}") for i, j in _pairs(p)),
        )
        g = g.withColumn("n_eff", F.col("w1") * F.col("w1") / F.col("w2"))
        scale = 1 / (1 - F.col("w2") / (F.col("w1") * F.col("w1")))
        mean = lambda i: F.col(f"m{i}")
        # the means' own rounding, taken out again
        left = lambda i: F.col(f"r{i}") / F.col("w1")
        cov = lambda i, j: (F.col(f"c{i}_{j}") / F.col("w1") - left(i) * left(j)) * scale
    return g.select(*keys, "n_obs", "n_eff", "first_date", "last_date", F.array(*(mean(i) for i in range(p))).alias("mean"), _square(p, cov).alias("cov"))


def deviations(rows: DataFrame, nodes) -> DataFrame:
    """Rows with each node less its panel's mean, and those means as ``_centre`` (array): what samples of the whole panel are summed from."""
    means = rows.groupBy(PANEL).agg(F.array(*(F.avg(col(n)) for n in nodes)).alias("_centre"))
    return rows.join(means, PANEL).withColumns({n: col(n) - F.col("_centre")[i] for i, n in enumerate(nodes)})


def products(nodes) -> list[Column]:
    """Nodes, then products of each pair of nodes (i <= j): what :func:`from_sums` makes moments of."""
    return [col(n) for n in nodes] + [col(nodes[i]) * col(nodes[j]) for i, j in _pairs(len(nodes))]


def from_sums(rows: DataFrame, p: int, keys) -> DataFrame:
    """Moment rows (as :func:`moments` makes) of rows with n, first_date, last_date, sums (of :func:`products` of :func:`deviations`) and _centre.

    A sample drawn from the whole panel lies about its mean, so these sums lose nothing to cancellation.
    """
    n, s = F.col("n"), F.col("sums")
    at = {pair: p + k for k, pair in enumerate(_pairs(p))}
    cov = lambda i, j: (s[at[i, j]] - s[i] * s[j] / n) / (n - 1)
    return rows.select(*keys, n.cast("long").alias("n_obs"), n.cast("double").alias("n_eff"), "first_date", "last_date", F.array(*(F.col("_centre")[i] + s[i] / n for i in range(p))).alias("mean"), _square(p, cov).alias("cov"))


def covariance_table(moment_rows: DataFrame, nodes, keys=(PANEL,)) -> DataFrame:
    """keys, node_i, node_j, cov, corr for each ordered pair of nodes."""
    p = len(nodes)
    cells = [
        F.struct(F.lit(nodes[i]).alias("node_i"), F.lit(nodes[j]).alias("node_j"), F.col("cov")[i * p + j].alias("cov"), (F.col("cov")[i * p + j] / F.sqrt(F.col("cov")[i * p + i] * F.col("cov")[j * p + j])).alias("corr"))
        for i in range(p) for j in range(p)
    ]
    return moment_rows.select(*keys, "n_obs", "n_eff", F.explode(F.array(*cells)).alias("x")).select(*keys, "n_obs", "n_eff", "x.*")
