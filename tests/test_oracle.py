"""Every registered query with an SQL statement, on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert differences(df, connect(SF), entry.oracle_sql()[name])[0] is None
    else:
        assert df.count() > 0
