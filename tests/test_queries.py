import pytest
from oracle import check

from keyloom.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, sf, name):
    check(spark, QUERIES[name], ORACLE[name], sf)
