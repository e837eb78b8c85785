"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over 1 / HOT_KEYS of all rows is hot, and so is one with over HOT_ROWS of them: the larger of HOT_KEYS and
#: total / HOT_ROWS bounds how many hot keys there are (100,000 small rows among 10^12), and HOT_ROWS what any other key brings to a task.
HOT_KEYS, HOT_ROWS = 500, 10_000_000


def split_join(rows: DataFrame, keyed: DataFrame, on: dict[str, str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``keyed``, which has one row for each key.

    ``on``: column of ``rows`` to column of ``keyed`` (no names in common; null equals null). ``weight``: column
    of ``keyed`` with how many of the ``total`` rows have the key. The few hot keys' rows stay where they are
    and meet a broadcast of a row for each hot key; all others are shuffled by key.
    """
    same = None
    for a, b in on.items():
        one = F.col(a).eqNullSafe(F.col(b))
        same = one if same is None else same & one
    is_hot = F.col(weight) > min(total // HOT_KEYS, HOT_ROWS)
    hot = F.broadcast(keyed.where(is_hot))
    met = rows.join(hot, same)
    rest = rows.join(hot.select(*on.values()), same, "left_anti").join(keyed.where(~is_hot), same, how)
    return met.unionByName(rest)
