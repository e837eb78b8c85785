"""Seeded panels with known structure."""

import datetime as dt

import numpy as np

from panelfactor.operators.factors import shape_templates
from panelfactor.schema import TREASURY_CORE

NODES = TREASURY_CORE


def factor_changes(rows=400, seed=17, sigmas=(20.0, 8.0, 3.0), noise=0.15, ar=(0.0, 0.0, 0.0)):
    """Changes made of the three shapes times (autoregressive) normal scores, plus noise."""
    rng = np.random.default_rng(seed)
    scores = np.zeros((rows, 3))
    for t in range(rows):
        scores[t] = (np.array(ar) * scores[t - 1] if t else 0) + rng.normal(0, sigmas)
    return scores @ shape_templates(NODES.maturities) + rng.normal(0, noise, (rows, len(NODES.names)))


def wide(spark, values, panel="p", first=dt.date(2015, 1, 2), nodes=NODES):
    """A change table as the operators expect it."""
    n = len(values)
    rows = [(panel, first + dt.timedelta(7 * k), first + dt.timedelta(7 * k), *map(float, v), 7, k, n) for k, v in enumerate(values)]
    fields = ", ".join(f"`{x}` double" for x in nodes.names)
    return spark.createDataFrame(rows, f"panel string, date date, period_end date, {fields}, gap_days int, pos long, n_rows long")
