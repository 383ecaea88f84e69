import pytest

from millrace.plans import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    found = df.collect()
    sql = oracle.connect(data).sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert oracle.rows(df.columns, found) == oracle.rows(list(sql.columns), sql.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
