"""Every query that has an oracle gives the oracle's rows."""

import pytest

from tests.oracle import differences
from wordloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
