import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
