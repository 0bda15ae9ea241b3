"""Every query of the catalogue beside its SQL; queries without SQL must run with stable names."""

import pytest
from compare import SMALL, duck_rows, spark_rows

from heddle import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, SMALL)) == duck_rows(catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
