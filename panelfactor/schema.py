"""Names, node universes and statuses that the operators share.

A wide panel has one row for each (panel, date) and a double column for each node; ``panel`` tells
independent curves apart, and every operator partitions by it. Changes also carry ``pos``, the
0-based place of a row in its panel, since many operators count rows and DataFrames have no order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PANEL, DATE, POS, PERIOD_END, GAP = "panel", "date", "pos", "period_end", "gap_days"
PASS, WARN, FAIL, NOT_EVALUATED, INCONCLUSIVE = "PASS", "WARN", "FAIL", "NOT EVALUATED", "INCONCLUSIVE"
NEEDS_REVISION, WITH_CAVEATS, READY = "NEEDS REVISION", "SHARE WITH CAVEATS", "READY TO SHARE"

# Public series ids of the constant-maturity Treasury curve, tenors and maturities in years (fixed values).
TREASURY_NODES = (
    ("DGS1MO", "1M", 1 / 12),
    ("DGS3MO", "3M", 0.25),
    ("DGS6MO", "6M", 0.5),
    ("DGS1", "1Y", 1.0),
    ("DGS2", "2Y", 2.0),
    ("DGS3", "3Y", 3.0),
    ("DGS5", "5Y", 5.0),
    ("DGS7", "7Y", 7.0),
    ("DGS10", "10Y", 10.0),
    ("DGS20", "20Y", 20.0),
    ("DGS30", "30Y", 30.0),
)
NOT_CORE = ("1M", "30Y")


@dataclass(frozen=True)
class Nodes:
    """An ordered universe of nodes with maturities, and source ids where a source has its own names."""

    names: tuple[str, ...]
    maturities: tuple[float, ...]
    series_ids: tuple[str, ...] = ()

    def __post_init__(self):
        if len(set(self.names)) != len(self.names) or len(self.names) < 3:
            raise ValueError("a universe needs three or more distinct nodes")
        if len(self.maturities) != len(self.names) or len(set(self.maturities)) != len(self.names) or min(self.maturities) <= 0:
            raise ValueError("each node needs a positive maturity of its own")
        if self.series_ids and len(self.series_ids) != len(self.names):
            raise ValueError("series ids must match the nodes")

    def subset(self, names) -> Nodes:
        at = [self.names.index(n) for n in names]
        return Nodes(tuple(self.names[k] for k in at), tuple(self.maturities[k] for k in at), tuple(self.series_ids[k] for k in at) if self.series_ids else ())


TREASURY = Nodes(tuple(x[1] for x in TREASURY_NODES), tuple(x[2] for x in TREASURY_NODES), tuple(x[0] for x in TREASURY_NODES))
TREASURY_CORE = TREASURY.subset([n for n in TREASURY.names if n not in NOT_CORE])


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col(f"`{name}`")


def vector(names) -> Column:
    """The nodes of a wide row as one array."""
    return F.array(*(col(n) for n in names))
