"""Every registered query of the library against its DuckDB text."""

import oracle
import pytest

from lowstress.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    assert oracle.assert_same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name]) > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
