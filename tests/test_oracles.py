import oracle
import pytest

from terrapane.plans import more_queries, raster_queries, source_queries, world_queries  # noqa: F401
from terrapane.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, sf, name):
    columns, want_columns, got, want = oracle.compare(spark, db, QUERIES[name], ORACLES[name], sf)
    assert columns == want_columns
    assert got == want


def test_entry_runs_without_the_llm_folders(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["tile_id", "n"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
