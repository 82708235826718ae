"""Plans of joins that must not compare all pairs, and of scans that must be pruned."""

from __future__ import annotations

import pytest

from wayfold.plans import bindings
from wayfold.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn_01", "jn_02", "jn_09", "jn_10", "jn_12", "spa_01", "spa_02", "spa_09", "spa_11", "tm_01", "tm_14", "sim_01", "sim_03", "sim_04", "rg_03", "rg_05", "rg_07", "lb_01", "agg_04", "tm_05", "tm_06", "tm_13", "spa_12", "rte_03", "jn_06", "gl_11", "win_06"])
def test_no_nested_loops(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_columns_are_pruned_and_filters_pushed(spark):
    p = plan(bindings.read(spark, SF, "lineitem").where("l_quantity > 10").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p and "l_extendedprice" not in p
    p = plan(QUERIES["cnt_01"](spark, SF))
    assert "l_extendedprice" not in p and "l_quantity" not in p


def test_rankings_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_03"](spark, SF))
