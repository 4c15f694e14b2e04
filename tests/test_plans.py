"""Plans: raw tables are read once, by few columns; what several measures need is written in between."""

import pytest

from tamarack import catalog, catalog_reports

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["egress_scored", "egress_banded", "rare_process", "lineage_breadth", "subsumed", "dga_scored", "beacon_scored", "fanout_scored"])
def test_scans_of_raw_tables(spark, name):
    assert catalog_reports.QUERIES is catalog.QUERIES
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan") if DATA in x]
    assert len(scans) <= 2, plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["fanout_scored"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    (scan,) = [x for x in plan.split("FileScan") if "lineitem.parquet" in x]
    assert "PushedFilters: [" in scan and "l_linenumber" in scan.split("PushedFilters", 1)[1]
    assert "l_extendedprice" not in scan.split("ReadSchema", 1)[1][:300]
