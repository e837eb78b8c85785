"""Factor models: principal components of a panel with level, slope and curvature identified.

A model is a row: arrays of centre, scale, eigenvalues, components and labels, made from the panel's
moments by a p x p eigendecomposition. Scores and reconstructions are column expressions over those
arrays, so rows of observations never leave the JVM.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, PANEL, POS, vector
from .moments import ewma_weight, moments

SHAPES = ("Level", "Slope", "Curvature")
TINY = float(np.finfo(float).eps)
MODEL = "center array<double>, scale array<double>, eigenvalues array<double>, share array<double>, components array<array<double>>, physical array<array<double>>, labels array<string>, suggested array<string>, identified array<boolean>, similarity array<double>, margin array<double>"


def shape_templates(maturities) -> np.ndarray:
    """Orthonormal level, slope and curvature over log maturity, one in each row.

    Gram-Schmidt of 1, z, z^2 for z = ln(maturity) less its mean; level is positive, slope rises with maturity,
    curvature is high in the middle.
    """
    years = np.asarray(maturities, float)
    if years.ndim != 1 or len(np.unique(years)) != len(years) or len(years) < 3 or not (np.isfinite(years) & (years > 0)).all():
        raise ValueError("templates need three or more distinct positive maturities")
    z = np.log(years) - np.log(years).mean()
    rows: list[np.ndarray] = []
    for target in (np.ones_like(z), z, -(z**2)):
        left = target - sum((row @ target) * row for row in rows)
        rows.append(left / np.linalg.norm(left))
    return np.stack(rows)


def decompose(mean, cov, templates, standardize: bool = False, least_similarity: float = 0.70, least_margin: float = 0.10) -> dict:
    """:func:`decompose_many` of one (mean, covariance)."""
    mean = np.asarray(mean, float)
    made = decompose_many(mean[None], np.asarray(cov, float).reshape(1, len(mean), len(mean)), templates, standardize, least_similarity, least_margin)
    return {k: v[0] for k, v in made.items()}


def decompose_many(mean: np.ndarray, cov: np.ndarray, templates, standardize: bool = False, least_similarity: float = 0.70, least_margin: float = 0.10) -> dict:
    """Model arrays of a stack of means (m, p) and covariances (m, p, p); None entries where a node has no variance.

    Eigenvalues descend and are not negative. The first three components are compared with the templates
    in physical space; one is identified if its match is close enough and beats its other templates by
    the margin. Signs: the first three along their template, others with their largest loading positive.
    """
    m, p = mean.shape
    variance = np.diagonal(cov, axis1=1, axis2=2)
    good = np.isfinite(cov).all(axis=(1, 2)) & (variance > TINY).all(axis=1)
    safe = np.where(good[:, None, None], cov, np.eye(p))
    scale = np.sqrt(np.diagonal(safe, axis1=1, axis2=2)) if standardize else np.ones((m, p))
    values, vectors = np.linalg.eigh(safe / (scale[:, :, None] * scale[:, None, :]))
    values, comps = np.clip(values[:, ::-1], 0, None), vectors[:, :, ::-1].transpose(0, 2, 1)
    physical = comps * scale[:, None, :]
    unit = physical[:, :3] / np.linalg.norm(physical[:, :3], axis=2, keepdims=True)
    cosine = np.abs(unit @ templates.T)
    chosen = assign_many(cosine)  # template of each component
    matched = np.take_along_axis(cosine, chosen[:, :, None], axis=2)[:, :, 0]
    margin = matched - np.where(np.arange(3) == chosen[:, :, None], -np.inf, cosine).max(axis=2)
    identified = (matched >= least_similarity) & (margin >= least_margin)
    along = (unit * templates[chosen]).sum(axis=2)
    largest = np.take_along_axis(comps, np.abs(comps).argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
    largest[:, :3] = along
    signs = np.where(largest < 0, -1.0, 1.0)[:, :, None]
    comps, physical = comps * signs, physical * signs
    suggested = [[SHAPES[c] for c in row] for row in chosen]
    shapes = [[x if ok else "Unidentified" for x, ok in zip(row, sure, strict=True)] + ["Residual"] * (p - 3) for row, sure in zip(suggested, identified, strict=True)]
    made = {
        "center": list(mean), "scale": list(scale), "eigenvalues": list(values), "share": list(values / values.sum(axis=1, keepdims=True)), "components": [list(x) for x in comps], "physical": [list(x) for x in physical],
        "labels": [[f"PC{k + 1} {x}" for k, x in enumerate(row)] for row in shapes], "suggested": suggested, "identified": identified.tolist(), "similarity": list(matched), "margin": list(margin),
    }
    return {k: [x if ok else None for x, ok in zip(v, good, strict=True)] for k, v in made.items()}


def assign_many(similarity: np.ndarray) -> np.ndarray:
    """For each row i of each matrix the column that is matched to it, with the largest sum; the first of equal choices."""
    k = similarity.shape[1]
    orders = np.array(list(permutations(range(k))))
    sums = similarity[:, np.arange(k), orders].sum(axis=2)
    return orders[sums.argmax(axis=1)]


def fields(df: DataFrame, names) -> str:
    """DDL of some of a frame's columns."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def per_row(rows: DataFrame, kernel, keep, out: str) -> DataFrame:
    """``rows`` with the columns of ``out`` that ``kernel(row)`` (a dict) gives; rows are small summaries, Arrow-batched."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for batch in batches:
            made = [kernel(row) for row in batch.to_dict("records")]
            yield pd.concat([batch[list(keep)].reset_index(drop=True), pd.DataFrame(made, columns=names, dtype=object)], axis=1)

    return rows.mapInPandas(run, f"{fields(rows, keep)}, {out}")


def per_batch(rows: DataFrame, kernel, keep, out: str) -> DataFrame:
    """``rows`` with the columns of ``out`` that ``kernel(batch)`` gives as a dict of lists: linear algebra runs on stacks."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for batch in batches:
            made = kernel(batch) if len(batch) else {n: [] for n in names}
            # object columns are filled cell by cell, since numpy would make one array of equal-length lists
            new = {n: pd.Series([None] * len(batch), dtype=object) for n in names}
            for n in names:
                new[n][:] = pd.Series(made[n], dtype=object).to_numpy() if len(batch) else []
            yield pd.concat([batch[list(keep)].reset_index(drop=True), pd.DataFrame(new)], axis=1)

    return rows.mapInPandas(run, f"{fields(rows, keep)}, {out}")


def stacked(column, *shape) -> np.ndarray:
    """Arrays of a pandas column as one array; None entries inside are not numbers."""
    return np.array([np.asarray(v, float) for v in column]).reshape(len(column), *shape)


def models(moment_rows: DataFrame, maturities, standardize: bool = False, least_similarity: float = 0.70, least_margin: float = 0.10, keys=(PANEL,)) -> DataFrame:
    """A model row for each row of moments; panels with a constant node get null arrays."""
    templates = shape_templates(maturities)
    p = len(templates[0])
    return per_batch(moment_rows, lambda b: decompose_many(stacked(b["mean"], p), stacked(b["cov"], p, p), templates, standardize, least_similarity, least_margin), [*keys, "n_obs", "n_eff", "first_date", "last_date"], MODEL)


def fit(changes: DataFrame, nodes, standardize: bool = False, halflife: float | None = None, **thresholds) -> DataFrame:
    """The model of each panel's changes: covariance, correlation (``standardize``) or recency-weighted (``halflife``)."""
    weight = ewma_weight(halflife) if halflife else None
    return models(moments(changes, nodes.names, weight=weight), nodes.maturities, standardize, **thresholds)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def score_array(x: Column) -> Column:
    """Scores of an array of node changes under the model columns of the row."""
    z = F.zip_with(F.zip_with(x, F.col("center"), lambda a, c: a - c), F.col("scale"), lambda a, s: a / s)
    return F.transform("components", lambda v: dot(v, z))


def inverse_array(scores: Column, k: int, p: int) -> Column:
    """Node changes that the first ``k`` scores stand for."""
    return F.array(*(F.col("center")[i] + sum((scores[j] * F.col("physical")[j][i] for j in range(k)), F.lit(0.0)) for i in range(p)))


def with_model(changes: DataFrame, model: DataFrame, keys=(PANEL,)) -> DataFrame:
    """Rows joined with their panel's model (one row for each panel: Spark broadcasts it when it is small)."""
    named = model.drop("n_obs", "n_eff", "first_date", "last_date")
    return changes.join(named, list(keys))


def transform(changes: DataFrame, model: DataFrame, nodes) -> DataFrame:
    """panel, date, pos, scores (array) of each row."""
    return with_model(changes, model).select(PANEL, DATE, POS, score_array(vector(nodes.names)).alias("scores"))


def reconstruct(changes: DataFrame, model: DataFrame, nodes, k: int) -> DataFrame:
    """Long table of actual and reconstructed changes: panel, date, pos, node, actual, fitted."""
    names = nodes.names
    if not 1 <= k <= len(names):
        raise ValueError("k must lie between one and the number of nodes")
    rows = with_model(changes, model).withColumn("scores", score_array(vector(names))).withColumn("fitted", inverse_array(F.col("scores"), k, len(names)))
    cells = F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("node"), vector(names).alias("actual"), F.col("fitted"))
    return rows.select(PANEL, DATE, POS, F.explode(cells).alias("x")).select(PANEL, DATE, POS, "x.node", "x.actual", "x.fitted")


def error_metrics(pairs: DataFrame) -> DataFrame:
    """MAE, RMSE, P95 and maximum of |actual - fitted| for each (panel, node), and for all nodes (node null)."""
    e = pairs.withColumn("e", F.abs(F.col("actual") - F.col("fitted")))
    grouped = e.groupingSets([[F.col(PANEL), F.col("node")], [F.col(PANEL)]], F.col(PANEL), F.col("node"))
    return grouped.agg(F.count("*").alias("n_obs"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.percentile("e", F.lit(0.95)).alias("p95"), F.max("e").alias("max_error"))


def component_table(model: DataFrame, k: int | None = None) -> DataFrame:
    """One row for each component: eigenvalue, share, cumulative share, label, suggested shape, identification."""
    rows = model.select(PANEL, F.posexplode(F.arrays_zip("eigenvalues", "share", "labels", "suggested", "identified", "similarity", "margin")).alias("k", "x"), "share")
    table = rows.select(PANEL, (F.col("k") + 1).alias("component"), F.col("x.labels").alias("label"), F.col("x.eigenvalues").alias("eigenvalue"), F.col("x.share").alias("share"), F.aggregate(F.slice(F.col("share"), F.lit(1), F.col("k") + 1), F.lit(0.0), lambda s, x: s + x).alias("cumulative_share"), F.col("x.suggested").alias("suggested_shape"), F.col("x.identified").alias("identified"), F.col("x.similarity").alias("similarity"), F.col("x.margin").alias("margin"))
    return table.where(F.col("component") <= k) if k else table


def loading_table(model: DataFrame, nodes, k: int) -> DataFrame:
    """For each of the first k components and each node: loading, physical basis, one-sigma shock, correlation of node and factor."""
    rows = model.select(PANEL, "scale", "eigenvalues", "physical", F.posexplode(F.slice("components", 1, k)).alias("k", "v"))
    names = F.array(*(F.lit(n) for n in nodes.names))
    rows = rows.select("*", F.posexplode(names).alias("i", "node"))
    shock = F.col("physical")[F.col("k")][F.col("i")] * F.sqrt(F.col("eigenvalues")[F.col("k")])
    variance = F.aggregate(F.sequence(F.lit(0), F.lit(len(nodes.names) - 1)), F.lit(0.0), lambda s, m: s + F.pow(F.col("physical")[m][F.col("i")], 2) * F.col("eigenvalues")[m])
    return rows.select(PANEL, (F.col("k") + 1).alias("component"), "node", F.col("v")[F.col("i")].alias("loading"), F.col("physical")[F.col("k")][F.col("i")].alias("physical_loading"), shock.alias("one_sigma_shock"), F.when(variance > 0, shock / F.sqrt(variance)).otherwise(0.0).alias("node_correlation"))


def artifacts(changes: DataFrame, model: DataFrame, nodes, k: int) -> dict[str, DataFrame]:
    """The tables of a model, by name: components, centre_scale, loadings, physical_basis, one_sigma_shocks (all components), scores."""
    names = F.array(*(F.lit(n) for n in nodes.names))
    every = loading_table(model, nodes, len(nodes.names))
    return {
        "components": component_table(model), "centre_scale": model.select(PANEL, F.explode(F.arrays_zip(names.alias("node"), "center", "scale")).alias("x")).select(PANEL, "x.node", F.col("x.center").alias("centre"), "x.scale"),
        "loadings": loading_table(model, nodes, k), "physical_basis": every.select(PANEL, "component", "node", "physical_loading"), "one_sigma_shocks": every.select(PANEL, "component", "node", "one_sigma_shock"), "scores": transform(changes, model, nodes),
    }


def row_space(basis: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the rows of each basis of a stack; an error if one lacks full rank."""
    q, r = np.linalg.qr(np.swapaxes(basis, -1, -2))
    size = np.linalg.norm(r, 2, axis=(-2, -1))[..., None]
    if (np.abs(np.diagonal(r, axis1=-2, axis2=-1)) <= TINY * max(basis.shape[-2:]) * size).any():
        raise ValueError("the basis lacks full rank")
    return np.swapaxes(q, -1, -2)


def compare(reference: dict, candidate: dict, k: int) -> dict:
    """:func:`compare_many` of one pair of models."""
    side = lambda m: {c: [m[c]] for c in ("physical", "eigenvalues", "share", "similarity")}
    return {name: v[0] for name, v in compare_many(side(reference), side(candidate), k).items()}


def compare_many(reference: dict, candidate: dict, k: int) -> dict:
    """How candidate models' first k factors lie against their references', in physical space.

    Both: columns physical, eigenvalues, share, similarity. Cosines are per matched factor; principal
    angles (degrees) belong to the subspaces and are ordered.
    """
    basis = [np.array([[np.asarray(v, float) for v in rows[:k]] for rows in m["physical"]]) for m in (reference, candidate)]
    a, b = basis
    ua, ub = (x / np.linalg.norm(x, axis=2, keepdims=True) for x in basis)
    similarity = np.abs(ua @ ub.transpose(0, 2, 1))  # rows: the reference's factors
    match = assign_many(similarity)  # the candidate factor of each
    qa, qb = row_space(a), row_space(b)
    angles = np.degrees(np.arccos(np.clip(np.linalg.svd(qb @ qa.transpose(0, 2, 1), compute_uv=False), -1, 1)))
    values = [np.array([np.asarray(v, float) for v in m["eigenvalues"]]) for m in (reference, candidate)]
    sigma = [np.linalg.norm(x, axis=2) * np.sqrt(v[:, :k]) for x, v in zip(basis, values, strict=True)]
    project = lambda q: q.transpose(0, 2, 1) @ q
    gaps = [(v[k - 1] - v[k]) / v[k - 1] if k < len(v) and v[k - 1] > 0 else None for v in values[1]]
    return {
        "cosines": list(np.take_along_axis(similarity, match[:, :, None], axis=2)[:, :, 0]), "angles": list(angles), "max_angle": angles.max(axis=1).tolist(), "matched": (match + 1).tolist(),
        "projection_distance": (np.linalg.norm(project(qb) - project(qa), axis=(1, 2)) / np.sqrt(2 * k)).tolist(), "cutoff_gap": gaps,
        "reference_sigma": list(sigma[0]), "candidate_sigma": list(np.take_along_axis(sigma[1], match, axis=1)), "top_share": [float(np.asarray(v, float)[:k].sum()) for v in candidate["share"]], "min_similarity": [float(np.min(v)) for v in candidate["similarity"]],
    }


COMPARISON = "cosines array<double>, angles array<double>, max_angle double, matched array<int>, projection_distance double, cutoff_gap double, reference_sigma array<double>, candidate_sigma array<double>, top_share double, min_similarity double"


def prefixed(model: DataFrame, prefix: str, keys=(PANEL,)) -> DataFrame:
    return model.select(*keys, *(F.col(c).alias(prefix + c) for c in model.columns if c not in keys))


def compare_models(reference: DataFrame, candidate: DataFrame, k: int, keys=(PANEL,)) -> DataFrame:
    """Comparison arrays of two models of each panel, with both spans and counts."""
    both = prefixed(reference, "r_", keys).join(prefixed(candidate, "c_", keys), list(keys)).where("r_center is not null and c_center is not null")

    def kernel(batch):
        side = lambda p: {c: batch[p + c] for c in ("physical", "eigenvalues", "share", "similarity")}
        return compare_many(side("r_"), side("c_"), k)

    spans = [f"{p}{c}" for p in ("r_", "c_") for c in ("n_obs", "first_date", "last_date")]
    return per_batch(both, kernel, [*keys, *spans], COMPARISON)


def regime_table(comparison: DataFrame, keys=(PANEL,)) -> DataFrame:
    """One row for each matched factor of a comparison."""
    x = F.posexplode(F.arrays_zip("cosines", "angles", "matched", "reference_sigma", "candidate_sigma")).alias("k", "x")
    spans = [c for c in comparison.columns if c[:2] in ("r_", "c_")]
    return comparison.select(*keys, *spans, x).select(*keys, (F.col("k") + 1).alias("factor"), F.col("x.matched").alias("matched_component"), F.col("x.cosines").alias("cosine"), F.col("x.angles").alias("principal_angle"), F.col("x.reference_sigma").alias("reference_sigma"), F.col("x.candidate_sigma").alias("candidate_sigma"), (F.col("x.candidate_sigma") / F.col("x.reference_sigma")).alias("sigma_ratio"), *spans)


def component_of(model: DataFrame, shape: str) -> DataFrame:
    """panel, component (1-based; null if none is identified) of the factor with a shape."""
    if shape not in SHAPES:
        raise ValueError(f"a shape is one of {SHAPES}")
    at = F.coalesce(*(F.when(F.col("identified")[j] & (F.col("suggested")[j] == shape), F.lit(j + 1)) for j in range(3)))
    return model.select(PANEL, at.alias("component"))


def score_unit(standardize: bool) -> str:
    """What scores are measured in."""
    return "standard deviations" if standardize else "hundredths (basis points)"
