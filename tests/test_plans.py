"""Physical plans: no row-level work in one task, filters reach the files, no Python in core plans."""

import re

import pytest
from paths import SF

from riskloom import registry
from riskloom.fixtures import Warehouse
from riskloom.operators import relational as R

NO_PYTHON = [n for n in registry.QUERIES if n.startswith("q") and n[1:3].isdigit()] + [
    "score_batch", "trailing_features", "active_model_asof", "auc_exact", "quantiles", "dq_profile", "zscore_filter",
    "engineer_features", "batch_process", "bias_groups", "drift_psi"]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_core_plans(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    physical = text[text.index("== Physical Plan =="):]
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", physical)
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_literal_time_reaches_the_files(spark):
    df = R.lookback_filter(spark.read.parquet(f"{SF}/events.parquet"), "ts", 7, "2024-01-30 00:00:00").select("ts", "value")
    physical = plan(df)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", physical)
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in physical


def test_unused_line_items_are_not_read(spark):
    physical = plan(Warehouse(spark, SF).risk_assessments.select("risk_score"))
    assert "lineitem" not in physical[physical.index("== Physical Plan =="):]


def test_zscore_has_no_window(spark):
    assert "Window" not in plan(R.zscore_filter(Warehouse(spark, SF).transactions, "amount"))
