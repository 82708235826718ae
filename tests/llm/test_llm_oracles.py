"""Training-data queries that SQL can express, against their SQL."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from wayfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert not (why := differences(connect(SF), ORACLES[name], QUERIES[name](spark, SF))), why
