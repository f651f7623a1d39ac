"""The stored search counts every hit, however many there are."""

from pulsegrid.plans import queries


def test_search_stored_has_no_limit(spark, sf_small):
    plan = queries.q_search_stored(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Limit" not in plan
