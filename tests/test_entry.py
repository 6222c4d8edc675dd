import __spark_entry__ as e


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())
