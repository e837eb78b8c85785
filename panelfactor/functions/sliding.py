"""Exact order statistics of sliding windows of rows.

Positions of a group are cut into chunks; a chunk also gets the ``window`` rows before it (its halo), so that chunks of one
long group are worked on by as many tasks. A task slides over its chunk with the window kept sorted: a row that enters or
leaves costs one binary search, and an order statistic is an index, however long the window is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one chunk; a chunk is never shorter than its halo.
CHUNK = 16_384
_CHUNK, _HALO = "_chunk", "_halo"


def quantile_of(kept: list[float], q: float) -> float:
    """Linear quantile of sorted values."""
    at = q * (len(kept) - 1)
    low = int(at)
    if low + 1 >= len(kept):
        return kept[-1]
    return kept[low] + (kept[low + 1] - kept[low]) * (at - low)


def _slide(values: np.ndarray, window: int, begin: int, read) -> list:
    """``read(sorted window)`` for each value from ``begin`` on, over up to ``window`` values before it; not a number counts as a place only."""
    kept: list[float] = []
    inside: deque = deque()
    out = []
    for k, v in enumerate(values.tolist()):
        if k >= begin:
            out.append(read(kept))
        inside.append(v)
        if v == v:
            insort(kept, v)
        if len(inside) > window:
            gone = inside.popleft()
            if gone == gone:
                del kept[bisect_left(kept, gone)]
    return out


def _pass(pos: str, value: str, window: int, read, result: str, carried: list[str], columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        begin = int(np.count_nonzero(table[_HALO].to_numpy(zero_copy_only=False)))
        values = table[value].to_numpy(zero_copy_only=False).astype(float)
        made = _slide(values, window, begin, read)
        own = table.slice(begin).select(columns)
        # the frame of row k holds rows k - window to k - 1
        last = np.arange(begin, len(values)) - 1
        first = np.maximum(last - window + 1, 0)
        none = last < 0
        for c in carried:
            whole = table[c].combine_chunks()
            for name, at in ((f"{c}_first", first), (f"{c}_last", last)):
                own = own.append_column(name, whole.take(pa.array(np.where(none, 0, at), mask=none)))
        return own.append_column(result, pa.array(made, pa.list_(pa.float64())))

    return run


def _over(rows: DataFrame, keys: list[str], pos: str, value: str, window: int, read, result: str, carried=()) -> DataFrame:
    """``rows`` with ``result`` (array of doubles, null over an empty frame) and the first and last values of ``carried`` in each row's frame.

    A frame is the up to ``window`` rows before the row; positions are 0, 1, ... in each group.
    """
    size = max(CHUNK, window)
    own = F.floor(F.col(pos) / size).cast("long")
    ahead = F.when(F.col(pos) % size >= size - window, F.array(own, own + 1)).otherwise(F.array(own))
    columns = rows.columns
    spread = rows.withColumn(_CHUNK, F.explode(ahead)).withColumn(_HALO, F.col(_CHUNK) > own)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    fields += [f"`{c}_{end}` {rows.schema[c].dataType.simpleString()}" for c in carried for end in ("first", "last")]
    return spread.groupBy(*keys, _CHUNK).applyInArrow(_pass(pos, value, window, read, result, list(carried), columns), ", ".join([*fields, f"`{result}` array<double>"]))


def sliding_quantiles(rows: DataFrame, keys: list[str], pos: str, value: str, window: int, points: list[float], result: str = "q") -> DataFrame:
    """Rows with ``result``: linear quantiles at ``points`` of the up to ``window`` values before each row (null without any).

    Null values take a place in the window and no part in the quantiles.
    """
    return _over(rows, keys, pos, value, window, lambda kept: [quantile_of(kept, q) for q in points] if kept else None, result)


def sliding_ranks(rows: DataFrame, keys: list[str], pos: str, value: str, window: int, ranks: list[int], result: str = "q", carried=()) -> DataFrame:
    """Rows with ``result``: the values of ``ranks`` (from 1, ascending) among exactly ``window`` values before each row (null with fewer)."""
    return _over(rows, keys, pos, value, window, lambda kept: [kept[k - 1] for k in ranks] if len(kept) == window else None, result, carried)
