import __spark_entry__ as entry


def test_registered(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0
