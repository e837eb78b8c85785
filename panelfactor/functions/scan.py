"""Running figures of long groups in two levels: inside chunks of rows, then over the chunks.

A group (a panel, a node of a panel) is cut by position into chunks of ``CHUNK`` rows, each a window partition of its own;
what came before a chunk is one small row for it. So one long group is worked on by as many tasks as it has chunks, and
no window holds more than ``CHUNK`` rows or one row for each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PANEL, POS, col

CHUNK = 65_536
_CHUNK = "_chunk"


def chunked(rows: DataFrame, pos: str) -> DataFrame:
    """Rows with the chunk that their position lies in."""
    return rows.withColumn(_CHUNK, F.floor(F.col(pos) / CHUNK).cast("long"))


def running_totals(rows: DataFrame, keys: list[str], pos: str, values: dict[str, Column]) -> DataFrame:
    """``keys``, ``pos`` and, for each name of ``values``, its total over the group's rows up to and with this one; nulls count as zero."""
    zero = F.lit(0.0)
    rows = chunked(rows.select(*keys, pos, *(F.coalesce(v.cast("double"), zero).alias(n) for n, v in values.items())), pos)
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, _CHUNK).agg(*(F.sum(n).alias(f"_t_{n}") for n in values))
    sums = sums.select(*keys, _CHUNK, *(F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_b_{n}") for n in values))
    local = rows.select(*keys, pos, _CHUNK, *(F.sum(n).over(upto).alias(n) for n in values))
    return local.join(sums, [*keys, _CHUNK]).select(*keys, pos, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in values))


def merge(a: dict, b: dict) -> dict:
    """(n, mean, m2) of two disjoint samples as that of both; exact up to rounding of what is merged, wherever the values lie.

    Arrays: n (...), mean (..., p), m2 (..., p, q) with means mean and, if there, other (..., q) for the second side.
    """
    n = a["n"] + b["n"]
    share = np.where(n > 0, b["n"] / np.where(n > 0, n, 1), 0.0)
    out = {"n": n}
    steps = {}
    for side in ("mean", "other"):
        if side in a:
            steps[side] = b[side] - a[side]
            out[side] = a[side] + steps[side] * share[..., None]
    left, right = steps["mean"], steps.get("other", steps["mean"])
    out["m2"] = a["m2"] + b["m2"] + left[..., :, None] * right[..., None, :] * (a["n"] * share)[..., None, None]
    return out


def _lists(table: pa.Table, name: str, *shape) -> np.ndarray:
    return np.array(table[name].to_pylist(), float).reshape(-1, *shape)


def _summary(p: int):
    """A chunk's rows in; its size, mean and co-moments, those of its neighbouring rows, and its first and last row out."""

    def run(table: pa.Table) -> pa.Table:
        x = _lists(table.sort_by(POS), "_x", p)
        now, past = x[1:], x[:-1]
        about = lambda v: v - v.mean(axis=0) if len(v) else v
        mean = lambda v: v.mean(axis=0) if len(v) else np.zeros(p)
        cells = [x.mean(axis=0), about(x).T @ about(x), mean(now), mean(past), about(now).T @ about(past), x[0], x[-1]]
        return pa.table([table[PANEL].slice(0, 1), table[_CHUNK].slice(0, 1), pa.array([len(x)], pa.int64()), *(pa.array([c.ravel().tolist()], pa.list_(pa.float64())) for c in cells)], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    return run


_SUMMARY = f"panel string, {_CHUNK} long, n long, mean array<double>, m2 array<double>, now array<double>, past array<double>, cross array<double>, first array<double>, last array<double>"
_STATE = "panel string, _of long, n long, mean array<double>, m2 array<double>, pairs long, now array<double>, past array<double>, cross array<double>, last array<double>"


def _before(p: int):
    """A panel's chunk summaries in; for each chunk the merged figures of all chunks before it out (one row for each CHUNK rows)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_CHUNK)
        n = table["n"].to_numpy().astype(float)
        mean, m2, now, past, cross, first, last = (_lists(table, c, *shape) for c, shape in (("mean", (p,)), ("m2", (p, p)), ("now", (p,)), ("past", (p,)), ("cross", (p, p)), ("first", (p,)), ("last", (p,))))
        zero, none = np.zeros(p), np.zeros((p, p))
        rows, pairs = {"n": np.float64(0), "mean": zero, "m2": none}, {"n": np.float64(0), "mean": zero, "other": zero, "m2": none}
        out = []
        for k in range(len(n)):
            edge = last[k - 1] if k else zero
            out.append((int(rows["n"]), rows["mean"], rows["m2"], int(pairs["n"]), pairs["mean"], pairs["other"], pairs["m2"], edge))
            if k:  # the pair that the boundary cuts
                pairs = merge(pairs, {"n": np.float64(1), "mean": first[k], "other": edge, "m2": none})
            rows = merge(rows, {"n": n[k], "mean": mean[k], "m2": m2[k]})
            pairs = merge(pairs, {"n": n[k] - 1, "mean": now[k], "other": past[k], "m2": cross[k]})
        columns = [pa.array(c) if np.ndim(c[0]) == 0 else pa.array([v.ravel().tolist() for v in c], pa.list_(pa.float64())) for c in zip(*out, strict=True)]
        return pa.table([table[PANEL], table[_CHUNK], *columns], names=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _run(p: int, columns: list[str]):
    """A chunk's rows and the figures of all rows before the chunk in; each row with those of all rows before it out."""

    def run(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        x = _lists(table, "_x", p)
        mean, m2, now, past, cross, previous = (_lists(state, c, *shape)[0] for c, shape in (("mean", (p,)), ("m2", (p, p)), ("now", (p,)), ("past", (p,)), ("cross", (p, p)), ("last", (p,))))
        n, pairs = int(state["n"][0].as_py()), int(state["pairs"][0].as_py())
        begin, out = n, {k: np.empty((len(x), size)) for k, size in (("mean", p), ("m2", p * p), ("cross", p * p))}
        for k, row in enumerate(x):
            out["mean"][k], out["m2"][k], out["cross"][k] = mean, m2.ravel(), cross.ravel()
            if n:
                pairs += 1
                off = row - now
                now = now + off / pairs
                past = past + (previous - past) / pairs
                cross = cross + np.outer(off, previous - past)
            n += 1
            off = row - mean
            mean = mean + off / n
            m2 = m2 + np.outer(off, row - mean)
            previous = row
        origin = _lists(table, "_first", p)
        before = np.vstack([_lists(state, "last", p), x[:-1]]) + origin
        lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
        made = [pa.array(np.arange(begin, begin + len(x), dtype=float)), lists(out["mean"] + origin), lists(out["m2"]), lists(out["cross"]), lists(origin), lists(before)]
        return pa.table([*(table[c] for c in columns), *made], names=[*columns, *_MADE])

    return run


_MADE = ("n_before", "mean", "m2", "cross", "x_first", "x_last")


def expanding_moments(rows: DataFrame, names, first_dates: bool = False) -> DataFrame:
    """Each row with the centred moments of all rows of its panel before it.

    n_before, mean, m2 (co-moments, row-major), cross (co-moments of each row, first index, and the row before it), x_first, x_last
    (the first row at a panel's first row), and first_date if asked for. Positions are 0, 1, ... Chunks are summarised, their
    summaries merged as (n, mean, m2), and each chunk then runs on from what lies before it, one row at a time: values far from zero lose
    no digits, and a long panel is as many tasks as it has chunks.
    """
    p, columns = len(names), rows.columns
    vector = F.array(*(col(n) for n in names))
    begin = rows.groupBy(PANEL).agg(F.min_by(vector, POS).alias("_first"), *([F.min("date").alias("first_date")] if first_dates else []))
    columns = [*columns, "first_date"] if first_dates else columns
    # distances from a panel's first row are small where its values are large
    own = chunked(rows.join(begin, PANEL).withColumn("_x", F.zip_with(vector, "_first", lambda v, o: v - o)), POS)
    summaries = own.groupBy(PANEL, _CHUNK).applyInArrow(_summary(p), _SUMMARY)
    states = summaries.groupBy(PANEL).applyInArrow(_before(p), _STATE)
    fields = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in columns] + ["n_before double", *(f"{c} array<double>" for c in _MADE[1:])]
    return own.groupBy(PANEL, _CHUNK).cogroup(states.groupBy(PANEL, "_of")).applyInArrow(_run(p, columns), ", ".join(fields))
