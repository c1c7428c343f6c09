"""Driver contract: entry() runs, every query has a builder, oracle keys are a subset."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "ground_truth", "predicted", "count"]
    assert df.count() > 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
