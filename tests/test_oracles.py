"""Every query that has an oracle gives the oracle's rows; of every other one the bounds hold."""

import os

import pytest

from fieldglass.plans import ALL_ORACLES, ALL_QUERIES
from tests.bounds import BOUNDS
from tests.compare import differences, oracle_rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, name):
    df = ALL_QUERIES[name](spark, SF_DIR)
    if name in ALL_ORACLES:
        assert (found := differences(df, ALL_ORACLES[name], SF_DIR)) is None, found
    else:
        BOUNDS[name](df.collect(), lambda sql: oracle_rows(sql, SF_DIR)[1])
