"""What the plans must look like: narrow scans, filters at the scan, no product of two tables."""

import os
import re

import pytest

from jobweft.plans import problems, relational

DATA = os.environ.get("JOBWEFT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(relational.QUERIES) + sorted(problems.QUERIES))
def test_no_cross_join(spark, name):
    text = plan({**relational.QUERIES, **problems.QUERIES}[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["search_topk", "facets", "search_capped_count", "modulo_partition", "fair_interleave", "two_key_count"])
def test_heavy_columns_are_not_read(spark, name):
    schemas = " ".join(re.findall(r"ReadSchema: struct<([^\n]*)", plan(relational.QUERIES[name](spark, DATA))))
    assert schemas and "description" not in schemas and "raw_data" not in schemas and "text:" not in schemas


def test_filters_reach_the_scan(spark):
    text = plan(relational.semi_live(spark, DATA))
    assert "IsNull(removed_at)" in text and "IsNull(removed_at)" in plan(relational.search_topk(spark, DATA))
    # only the first of each board can reach the page: the window is cut before the shuffle
    assert "WindowGroupLimit" in plan(relational.fair_interleave(spark, DATA))
    assert "TakeOrderedAndProject" in plan(relational.demand_top(spark, DATA))
