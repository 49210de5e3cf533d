"""Corpus scan (incl. files Spark's listing skips) and coverage XML."""

import os

from trees import write_tree
from quarry.operators import coverage as CV
from quarry.sources import corpus, reports


import pytest


@pytest.mark.parametrize("method", ["listing", "binaryFile"])
def test_scan_includes_underscore_hidden_and_empty(spark, tmpdir_path, method):
    write_tree(tmpdir_path, {
        "r1/pkg/__init__.py": "x = 1\n",
        "r1/pkg/_private.py": "y = 2\n",
        "r1/_internal/mod.py": "z = 3\n",
        "r1/empty.py": "",
        "r1/.hidden.py": "h = 1\n",
        "r1/a.py": "a = 1\n",
        "r1/bad.py": b"\xff\xfe\x00bad",
        "r1/notes.txt": "text",
        "r2/b.py": "b = 1\n",
    })
    got = {(r.repo, r.path): r.content
           for r in corpus.scan_corpus(spark, tmpdir_path, method=method).collect()}
    assert got == {
        ("r1", "pkg/__init__.py"): "x = 1\n", ("r1", "pkg/_private.py"): "y = 2\n",
        ("r1", "_internal/mod.py"): "z = 3\n", ("r1", "empty.py"): "",
        ("r1", ".hidden.py"): "h = 1\n", ("r1", "a.py"): "a = 1\n", ("r2", "b.py"): "b = 1\n",
    }


def test_list_tree_levels(spark, tmpdir_path):
    write_tree(tmpdir_path, {f"r/{'/'.join('d%d' % i for i in range(k))}/f{k}.py": "" for k in range(6)})
    got = {r.rel for r in corpus.list_tree(spark, tmpdir_path).collect()}
    assert got == {f"r/{'/'.join('d%d' % i for i in range(k))}/f{k}.py".replace("//", "/") for k in range(6)}


COV_XML = """<?xml version="1.0" ?>
<coverage>
  <packages>
    <package name="p">
      <classes>
        <class filename="full.py" line-rate="1.0"><lines>
          <line number="1" hits="3"/><line number="2" hits="1"/></lines></class>
        <class filename="part.py" line-rate="0.5"><lines>
          <line number="4" hits="0"/><line number="1" hits="2"/><line number="9" hits="0"/></lines></class>
        <class filename="zero.py" line-rate="0"><lines>
          <line number="1" hits="0"/></lines></class>
        <class filename="dup.py" line-rate="0.1"><lines><line number="1" hits="0"/></lines></class>
        <class filename="dup.py" line-rate="0.9"><lines><line number="1" hits="5"/><line number="2" hits="0"/></lines></class>
        <class filename="nolines.py" line-rate="1.0"><lines></lines></class>
        <class filename="odd.py" line-rate="0.5"><lines><line hits="00"/><line number="7"/></lines></class>
      </classes>
    </package>
  </packages>
</coverage>
"""


def test_coverage_xml(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "coverage.xml")
    with open(p, "w") as f:
        f.write(COV_XML)
    cov = reports.scan_coverage_xml(spark, p, repo="r")
    per = {r.filename: r for r in CV.coverage_per_file(cov).collect()}
    assert (per["full.py"].lines_covered, per["full.py"].lines_total, per["full.py"].line_rate) == (2, 2, 1.0)
    assert list(per["part.py"].uncovered_lines) == [4, 9] and per["part.py"].line_rate == 0.5
    assert per["zero.py"].lines_covered == 0 and per["zero.py"].lines_total == 1
    assert (per["nolines.py"].lines_total, per["nolines.py"].line_rate) == (0, 1.0)
    # no number reads as 0; hits "00" is not the text "0", so it counts as covered
    assert (per["odd.py"].lines_total, per["odd.py"].lines_covered, list(per["odd.py"].uncovered_lines)) == (2, 1, [7])
    # repeated filename: the last class element wins (rate taken as reported)
    assert (per["dup.py"].lines_total, per["dup.py"].line_rate, list(per["dup.py"].uncovered_lines)) == (2, 0.9, [2])
    files = spark.createDataFrame([("r", "full.py"), ("r", "absent.py")], "repo string, path string")
    j = {r.path: r for r in CV.join_coverage(files, CV.coverage_per_file(cov)).collect()}
    assert (j["absent.py"].lines_total, j["absent.py"].line_rate, list(j["absent.py"].uncovered_lines)) == (0, 0.0, [])


def test_missing_coverage_file_is_empty(spark, tmpdir_path):
    cov = reports.scan_coverage_xml(spark, os.path.join(tmpdir_path, "nope.xml"), repo="r")
    assert cov.count() == 0


def test_write_report_json(spark, tmpdir_path):
    df = spark.createDataFrame([("r", 1)], "repo string, n int")
    out = os.path.join(tmpdir_path, "rep")
    reports.write_report(df, out, "json")
    assert spark.read.json(out).count() == 1


def test_coverage_report_from_xml(spark, tmpdir_path):
    from trees import write_tree
    from quarry.plans import reports as R
    root = os.path.join(tmpdir_path, "corpus")
    write_tree(root, {"r/full.py": "a = 1\nb = 2\n", "r/part.py": "x = 1\n", "r/absent.py": "y = 1\n", "r/bad.py": "def (:\n"})
    xml = os.path.join(tmpdir_path, "coverage.xml")
    with open(xml, "w") as f:
        f.write(COV_XML)
    rep = R.coverage_report(R.scan(spark, root), coverage_xml={"r": xml})
    files = {r.path: (r.line_rate, r.priority) for r in rep["files"].collect()}
    assert files == {"full.py": (1.0, "low"), "part.py": (0.5, "medium"), "absent.py": (0.0, "medium")}
    # a file that does not parse counts among all files only
    total = rep["summary"].first()
    assert (total.total_files, total.tested_files, total.untested_files) == (4, 2, 1)
