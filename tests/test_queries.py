import pytest
from compare import oracle, rows

from plansmith import queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES and n != "research_split_documents"])
def test_query_equals_sql(spark, data, name):
    c, got = rows(queries.QUERIES[name](spark, data))
    assert got == oracle(queries.ORACLES[name], data, c)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_runs_twice_alike(spark, data, name):
    _, a = rows(queries.QUERIES[name](spark, data))
    _, b = rows(queries.QUERIES[name](spark, data))
    assert a and a == b


@pytest.mark.parametrize("name", ["fact_coverage", "evaluation_report"])
def test_outputs_are_not_broadcast_by_estimate(spark, data, name):
    """Exploded rows pass for as few as those they come from, so that a plan that trusts this collects all outputs in the driver."""
    assert "Broadcast" not in queries.QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
