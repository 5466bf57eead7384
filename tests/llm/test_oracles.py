import pytest

from tests.oracle import differences
from wordloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) == ""
