"""The queries that have SQL agree with it on the smallest tables."""

import pytest

from cairn.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import DATA, db, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):  # noqa: F811
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
