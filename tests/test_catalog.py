import pytest

from sievelake import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], SF) >= 0
