import pytest
from gridloom.plans import catalog
from oracle import differences


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, sf, name):
    assert name in catalog.oracle_sql()
    assert differences(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name]) == ""
