import pytest

from tests.compare import SF, assert_same
from titerlake.llm.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name])
