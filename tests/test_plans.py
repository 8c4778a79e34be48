"""Every registered query plans without Python UDFs, Cartesian products or nested-loop joins."""

import pytest

import __spark_entry__ as entry_mod

from conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("key", sorted(entry_mod.queries()))
def test_plan_shape(spark, key):
    df = entry_mod.queries()[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"


def test_rule_filter_reaches_the_scans(spark):
    spark.catalog.clearCache()  # a cached funnel view from another test would replace the scans
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plan text keeps whole filter lists
    try:
        df = entry_mod.queries()["rule_filter"](spark, SF_SMALL)
        scans = [l for l in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in l]
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    lineitem = next(l for l in scans if "l_orderkey" in l)
    part = next(l for l in scans if "p_partkey" in l)
    assert "GreaterThan(l_quantity,30.5)" in lineitem and "LessThanOrEqual(l_discount," in lineitem
    assert "In(p_type, [PROMO,SMALL])" in part
    assert "l_extendedprice" not in lineitem and "p_retailprice" not in part  # pruned columns
