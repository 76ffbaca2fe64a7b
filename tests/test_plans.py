"""What the physical plans of all core queries must not contain, and what a few must."""

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_compares_rows_pair_by_pair(spark):
    from sparlance.queries import QUERIES

    bad = []
    for name, q in QUERIES.items():
        text = plan(q(spark, SMALL))
        if "CartesianProduct" in text or "NestedLoopJoin" in text:
            bad.append(name)
    assert not bad


def test_filters_and_columns_reach_the_scan(spark):
    from sparlance.queries import QUERIES

    text = plan(QUERIES["metric_filter_order_limit"](spark, SMALL))
    assert "EqualTo(l_returnflag,R)" in text and "l_shipdate" not in text and "TakeOrderedAndProject" in text
    text = plan(QUERIES["run_metrics"](spark, SMALL))
    assert "messages" not in text and "raw_generation" not in text
    text = plan(QUERIES["metric_fanout_safe_sum"](spark, SMALL))
    assert "partial_sum" in text
    text = plan(QUERIES["rollout_history"](spark, SMALL))
    assert "Exchange" not in text


def test_top_values_are_limited_before_the_window(spark):
    from sparlance.queries import QUERIES

    assert "WindowGroupLimit" in plan(QUERIES["value_index_part"](spark, SMALL))
