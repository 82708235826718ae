"""Each query of the catalogue that SQL can express, against its SQL."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from wayfold.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert not (why := differences(con, ORACLES[name], QUERIES[name](spark, SF))), why


#: Queries without SQL, and the columns that name a row of theirs; other tests hold their operators against plain versions.
KEYS = {
    "det_02": "activity_id seq", "det_04": "activity_id seq", "det_05": "activity_id seq", "det_06": "activity_id seq", "det_08": "activity_id start end", "det_11": "activity_id seq", "det_12": "activity_id seq", "det_13": "activity_id seq", "det_14": "activity_id seq", "det_15": "activity_id seq",
    "det_16": "activity_id seq", "det_17": "algorithm activity_id", "tm_03": "activity_id start_t", "tm_07": "way_pos", "tm_08": "activity_id seq", "tm_09": "activity_id name chain part", "tm_10": "activity_id part", "rte_05": "activity_id first_idx", "rte_05_all": "route_id activity_id first_idx", "rte_08": "activity_id place", "rg_02": "id", "rg_04": "junction_id", "rg_09": "route_id pos",
    "sim_05": "v", "gl_02": "activity_id name chain part",
}
#: Those that find nothing in tables this small.
BARE = {"det_02", "det_06", "det_08", "det_11", "det_12", "det_13", "rte_05", "rte_05_all", "rte_08", "rg_02", "rg_04"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_are_named_once(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    names = [tuple(r[c] for c in KEYS[name].split()) for r in rows]
    assert len(set(names)) == len(names) and (names or name in BARE)
