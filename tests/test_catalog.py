import duckdb
import pytest

from postmill.plans import check
from postmill.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict = check.compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert verdict.startswith(("ok", "rows")), verdict


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
