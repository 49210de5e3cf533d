"""Invariants over the bound test tables (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import registry
from quarry.plans import q_context as QC
from quarry.plans import q_conventions as QV
from quarry.plans import reports as R
from quarry.plans.tables import doc_modules
from quarry.operators import context as CX
from trees import write_tree

SF = "/root/testdata/sf0.001"
need_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@need_tables
def test_budget_never_exceeded(spark):
    summ = CX.budget_summary(QC.conversation_tasks(spark, SF), QC._selected(spark, SF), QC.MAX_TOKENS)
    assert summ.where((F.col("used") > F.col("max_tokens")) | (F.col("remaining") < 0)).count() == 0


@need_tables
def test_selection_is_a_prefix_of_the_ranking(spark):
    ranked = CX.rank_relevant(QC._scored(spark, SF))
    sel = QC._selected(spark, SF).select("task_id", "path")
    j = ranked.join(sel.withColumn("picked", F.lit(True)), ["task_id", "path"], "left")
    per_task = j.groupBy("task_id").agg(
        F.max(F.when(F.col("picked"), F.col("rank"))).alias("last_pick"),
        F.min(F.when(F.col("picked").isNull(), F.col("rank"))).alias("first_skip"))
    assert per_task.where(F.col("first_skip") < F.col("last_pick")).count() == 0


@need_tables
def test_violation_lines_within_files(spark):
    v = QV.doc_violations(spark, SF).where(F.col("line").isNotNull())
    m = doc_modules(spark, SF)
    bad = v.join(m, ["repo", "path"]).where((F.col("line") > F.greatest(F.col("n_lines"), F.lit(1))))
    assert bad.count() == 0


def test_coverage_default_excludes_quirk(spark, tmpdir_path):
    write_tree(tmpdir_path, {"r/test_top.py": "x = 1\n", "r/pkg/test_b.py": "y = 1\n",
                             "r/pkg/c_test.py": "z = 1\n", "r/pkg/m.py": "m = 1\n"})
    c = R.scan(spark, tmpdir_path)
    files = {r.path for r in R.coverage_report(c)["files"].collect()}
    # fnmatch needs a '/' before test_, so a top-level test file is kept
    assert files == {"test_top.py", "pkg/m.py"}


@need_tables
def test_gap_ranks_are_sorted(spark):
    from quarry.operators import coverage as CV
    from quarry.plans import q_coverage as QCOV
    ranked = CV.gap_rank(QCOV._gaps(spark, SF), 50, 10).collect()
    by_repo = {}
    for r in ranked:
        by_repo.setdefault(r.repo, []).append(r)
    order = CV.PRIORITY_ORDER
    for rows in by_repo.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        keys = [(order[r.priority], -r.complexity) for r in rows]
        assert keys == sorted(keys)
        crit = [r for r in rows if r.in_critical_list]
        assert len(crit) <= 10 and all(r.priority == "critical" for r in crit)


@pytest.mark.parametrize("name", ["findings_conventions", "build_edges", "graph_nodes", "k_hop_3", "findings_deps"])
def test_what_several_branches_read_is_not_scanned_again(spark, name):
    registry.load_all()
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
