"""Every registered query with an SQL twin gives the same rows; the others give rows."""

from pathlib import Path

import pytest
from compare import compare, duck

from tidepanel.plans import ALL_QUERIES, ALL_SQL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF, ALL_QUERIES[name], ALL_SQL[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(ALL_QUERIES) - set(ALL_SQL)))
def test_has_rows(spark, name):
    """Rows, each column with values, no row twice."""
    rows = [tuple(map(str, r)) for r in ALL_QUERIES[name](spark, SF).collect()]
    assert rows and len(set(rows)) == len(rows)
    assert all(any(v != "None" for v in column) for column in zip(*rows))
