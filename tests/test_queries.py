"""Every registered query of the engine against its SQL on the driver's tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from tracemill.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        assert not differences(df, ORACLE_SQL[name], con)
    else:
        assert df.count() >= 0
