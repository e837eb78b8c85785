import pytest

from panelfactor.llm import queries as llm
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(llm.oracle_sql()[name]).df()
    whole = {c: "Int64" for c, kind in want.dtypes.items() if kind == "Int64"}  # nullable integers are floats in what Spark hands over
    same_rows(llm.queries()[name](spark, SF).toPandas().astype(whole), want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
