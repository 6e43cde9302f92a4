"""Every query outside the corpus subpackage against its SQL."""

import pytest
from compare import agree, connect

from tideglass.plans import audit_queries, evidence_queries, exact_queries, relational_queries, trading_queries

QUERIES = relational_queries.REGISTRY.queries | trading_queries.REGISTRY.queries | audit_queries.REGISTRY.queries | evidence_queries.REGISTRY.queries | exact_queries.REGISTRY.queries
ORACLES = relational_queries.REGISTRY.oracles | trading_queries.REGISTRY.oracles | audit_queries.REGISTRY.oracles | evidence_queries.REGISTRY.oracles | exact_queries.REGISTRY.oracles


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: A ``whole_`` name is the plain one's function and SQL under a second name.
SECOND = {n for n in ORACLES if n.startswith("whole_") and QUERIES.get(n) is QUERIES.get(n.removeprefix("whole_")) and ORACLES[n] == ORACLES.get(n.removeprefix("whole_"))}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SECOND))
def test_query_matches_sql(spark, sf, con, name):
    agree(QUERIES[name](spark, sf), con, ORACLES[name])


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
