import pytest

import oracle
from cindertrail.plans import core_queries, core_sql, engine_queries, engine_sql, log_queries, log_sql

QUERIES = {**core_queries.QUERIES, **log_queries.QUERIES, **engine_queries.QUERIES}
SQL = {**core_sql.SQL, **log_sql.SQL, **engine_sql.SQL}


#: Queries without SQL and the tests that check them.
ELSEWHERE = {
    "p4_templates": "test_loglines.py: template counts depend on the order of growth; every line is counted",
    "flow_edges": "its balance is checked by flow_balance; which of several largest flows is free",
    "matching_pairs": "its counts are checked by bipartite_matching; which of several largest matchings is free",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    assert name in SQL or name in ELSEWHERE
    oracle.compare(spark, sf, QUERIES[name], SQL.get(name))


def test_every_sql_has_its_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
