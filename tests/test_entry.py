import __spark_entry__
from crawlspark import management_queries as queries


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 50 and "indexable" in out.columns


def test_registry():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(queries.QUERIES) <= set(names)
