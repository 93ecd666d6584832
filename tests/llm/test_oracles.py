import pytest
from compare import oracle, rows

from plansmith.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    c, got = rows(registry.queries()[name](spark, data))
    assert got == oracle(registry.oracle_sql()[name], data, c)
