import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_linestatus", "revenue", "l_tax", "l_orderkey"]
