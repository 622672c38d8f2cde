"""Every small case of tests/literal_cases.py gives the rows that it states."""

import duckdb
import pytest

from tests import literal_cases as cases
from tests.test_catalog import plain


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    assert plain(cases.QUERIES[name](spark, "").toPandas()) == plain(duckdb.sql(cases.ORACLES[name]).df())
