"""Every registered query against its SQL text, or for its rows where there is none."""

import pytest

from reelframe.plans import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, data, key):
    result = compare(QUERIES[key](spark, data), con, SQL[key])
    assert result.startswith(("ok", "close")), result


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, key):
    df = QUERIES[key](spark, data)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
