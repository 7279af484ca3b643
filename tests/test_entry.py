"""Driver contract: flagship runs, every query has a name-matched oracle or is a stream."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"instance", "page_id", "file_name", "content", "n_same_slug"}
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


#: Not expressible in SQL; test_linediff.py holds it against a recursive alignment.
WITHOUT_SQL = {"dry_run_hunks"}


def test_every_query_has_an_oracle():
    assert set(E.REGISTRY) - set(E.oracle_sql()) == WITHOUT_SQL
    assert set(E.oracle_sql()) <= set(E.queries())
