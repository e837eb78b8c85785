import pytest

import __spark_entry__ as entry
from panelfactor.plans import oracles
from panelfactor.plans import queries as panels

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(panels.queries()[name](spark, SF).toPandas(), duck.execute(oracles.oracle_sql()[name]).df())


def test_entry_has_rows_at_the_smallest_scale(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and sorted(r.component for r in rows) == [1, 1, 2, 2, 3, 3]


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_is_pruned(spark, capsys):
    panels.weekly_changes(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "l_orderkey" not in schema and "l_extendedprice" in schema


def test_bootstrap_queries_take_the_default_replications(spark):
    q = panels.queries()
    assert all(r.tail_order_statistics >= 20 for r in q["interval_evidence"](spark, SF).collect())
    assert {r.replications for name in ("bootstrap_stability", "block_sensitivity") for r in q[name](spark, SF).collect()} == {2000}
