import oracle
import pytest

from terrapane.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, sf, name):
    columns, want_columns, got, want = oracle.compare(spark, db, QUERIES[name], ORACLES[name], sf)
    assert columns == want_columns
    assert got == want
