"""The queries of this subpackage that have SQL give its rows."""

import pytest

from fieldglass.llm.queries import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert (found := differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)) is None, found
