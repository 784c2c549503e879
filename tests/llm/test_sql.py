"""The operator queries that SQL can say."""

import pytest

from cladewise.llm import queries

from ..oracle import SF, compare, database


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    compare(queries.queries()[name](spark, SF), database(), queries.oracle_sql()[name])
