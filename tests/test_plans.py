"""Plan guards: properties every registered query's physical plan must keep."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]

# per-repo/top-k listings must be cut before their shuffle
TOP_K = ["severity_filter", "top_files", "first_n_entities", "gap_rank", "layer_rollup", "pack_files",
         "infer_convention", "hot_files"]


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_pairs_or_row_udfs(spark, name):
    p = plan(spark, name)
    for node in FORBIDDEN:
        assert node not in p, f"{name} plans a {node}"


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_is_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scan_prunes_columns(spark):
    p = plan(spark, "rule_line_length")
    assert "n_chars" not in p.split("ReadSchema")[1].split("\n")[0]
