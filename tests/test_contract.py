"""The driver contract on the smallest data."""

import __spark_entry__ as contract


def test_every_query_has_a_twin():
    own = set(contract.catalog.QUERIES)
    assert set(contract.catalog.ORACLES) == own and len(own) > 150
    assert set(contract.oracle_sql()) <= set(contract.queries()) and own <= set(contract.queries())


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(0 <= r.total_score <= 100 and r.status for r in rows)
