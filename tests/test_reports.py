"""The six reports end to end on a small two-repo corpus."""

import pytest

from trees import write_tree
from quarry.operators import coverage as CV
from quarry.plans import reports as R

MODELS = '''import os, sys as system
from collections import OrderedDict
import pandas as pd
MAX_SIZE = 10
Lower = 3

class Base(object):
    """A base."""
    def method(self, a, b=1):
        if a and b or a:
            return [i for i in range(a) if i]
        return None

    async def amethod(self):
        async with lock():
            pass

@dataclass
class badName(Base, pd.DataFrame):
    class Inner:
        pass

@app.get("/x")
def endpoint():
    with open("f") as f, ctx.manager() as g:
        return f

@router.post
def create_item(item) -> dict:
    """Create."""
    try:
        pass
    except ValueError:
        pass

def BadFunc():
    df = pd.read_csv("x"); y = pd.DataFrame().groupby("a").merge(z)
    return df
'''

TREE = {
    "repoA/pkg/__init__.py": '"""Package doc."""\nfrom . import models\n',
    "repoA/pkg/models.py": MODELS,
    "repoA/pkg/broken.py": "def broken(:\n  pass\n",
    "repoA/empty.py": "",
    "repoA/venv/x.py": "import numpy as np\n",
    "repoB/app/a.py": "import app.b\nimport app.c\n",
    "repoB/app/b.py": "import app.c\n" + "x = '" + "y" * 120 + "'\n# " + "c" * 120 + "\n",
    "repoB/app/c.py": "import app.a\nimport app.c\n",
    "repoB/app/__init__.py": "",
    "repoB/imports.py": "".join(f"import m{i}\n" for i in range(6)),
}


@pytest.fixture(scope="module")
def corpus(spark):
    import tempfile
    root = write_tree(tempfile.mkdtemp(prefix="quarry-rep-"), TREE)
    return R.scan(spark, root)


def by_repo(df):
    return {r.repo: r for r in df.collect()}


def test_arch(corpus):
    rep = R.arch_report(corpus)
    s = by_repo(rep["structure"])
    assert (s["repoA"].n_modules, s["repoA"].n_classes, s["repoA"].n_functions) == (4, 3, 3)
    m = by_repo(rep["metrics"])
    assert m["repoA"].total_lines == 2 + len(MODELS.splitlines()) + 0 + 1
    fw = by_repo(rep["frameworks"])
    assert list(fw["repoA"].frameworks) == ["numpy", "pandas"] and fw["repoA"].project_type == "data-analysis"
    assert fw["repoB"].project_type == "python"
    layers = {(r.repo, r.layer): (r.module_count, r.layer_rank) for r in rep["layers"].collect()}
    assert layers[("repoA", "pkg")] == (2, 1) and layers[("repoB", "app")] == (4, 1)
    edges = {(r["class"], r.base) for r in rep["class_edges"].collect()}
    assert edges == {("badName", "Base"), ("badName", "pd.DataFrame")}  # object dropped


def test_deps(corpus):
    rep = R.deps_report(corpus, max_cycle_len=3)
    e = {(r.src, r.dst) for r in rep["edges"].where("repo = 'repoB'").collect()}
    assert e == {("app.a", "app.b"), ("app.a", "app.c"), ("app.b", "app.c"), ("app.c", "app.a"), ("app.c", "app.c")}
    cyc = {r.cycle for r in rep["cycles"].collect()}
    assert cyc == {"app.c -> app.c", "app.a -> app.c -> app.a", "app.a -> app.b -> app.c -> app.a"}
    summ = by_repo(rep["summary"])
    assert (summ["repoB"].total_dependencies, summ["repoB"].circular_count) == (5, 3)
    f = {(r.repo, r.rule) for r in rep["findings"].collect()}
    assert ("repoB", "circular_dependencies") in f and ("repoA", "ok") in f


def test_patterns(corpus):
    rep = R.patterns_report(corpus)
    hits = {(r.type, r.operation or r.name) for r in rep["patterns"].collect()}
    assert hits == {("dataframe", "read_csv"), ("async", "amethod"), ("decorator", "create_item"),
                    ("context_manager", "open"), ("context_manager", "manager")}
    summ = {(r.repo, r.type): r.n for r in rep["summary"].collect()}
    assert summ[("repoA", "total")] == 5
    only_async = R.patterns_report(corpus, ["async"])["patterns"].collect()
    assert [r.type for r in only_async] == ["async"]


def test_conventions(corpus):
    rep = R.conventions_report(corpus)
    c = by_repo(rep["counts"])
    assert (c["repoA"].naming, c["repoA"].docstrings, c["repoA"].n_files) == (2, 7, 5)
    # repoB: b.py one long code line (the long comment is exempt), imports.py 6 consecutive imports
    assert (c["repoB"].style, c["repoB"].imports) == (1, 1)
    s = by_repo(rep["consistency"])
    assert s["repoA"].overall == 100 - int(9 / 14 * 100) and s["repoA"].docstrings_score == -40
    shown = {r.actual for r in rep["violations"].collect()}
    assert shown == {"BadFunc", "badName"}  # warnings only


def test_coverage(corpus, spark):
    cov = spark.createDataFrame([("repoA", "pkg/models.py", 1, 1), ("repoA", "pkg/models.py", 2, 0),
                                 ("repoA", "pkg/models.py", 3, 0), ("repoA", "pkg/models.py", 4, 0)],
                                "repo string, filename string, line_no int, hits long")
    rep = R.coverage_report(corpus, cov)
    files = {r.path: r for r in rep["files"].collect()}
    assert files["pkg/models.py"].line_rate == 0.25 and files["pkg/models.py"].priority == "critical"
    assert list(files["pkg/models.py"].reasons) == ["below_threshold"]
    summ = by_repo(rep["summary"])
    assert summ["repoA"].overall_coverage == 25.0 and summ["repoA"].tested_files == 1


def test_priority_rules(spark):
    pol = CV.GapPolicy()
    rows = [("r", "core/a.py", 0.0, 31), ("r", "core/b.py", 0.5, 0), ("r", "api/c.py", 0.4, 0),
            ("r", "x/d.py", 0.4, 51), ("r", "x/e.py", 0.7, 0), ("r", "x/f.py", 0.9, 0)]
    df = spark.createDataFrame(rows, "repo string, path string, line_rate double, complexity long")
    got = {r.path: r.p for r in df.select("path", CV.gap_priority(pol).alias("p")).collect()}
    assert got == {"core/a.py": "critical", "core/b.py": "critical", "api/c.py": "high",
                   "x/d.py": "high", "x/e.py": "medium", "x/f.py": "low"}


def test_context(corpus, spark):
    tasks = spark.createDataFrame([(1, "repoA", "fix the pandas dataframe model"), (2, "repoB", "new api")],
                                  "task_id long, repo string, text string")
    rep = R.context_report(corpus, tasks, max_tokens=100, focus_areas=["pkg"])
    sel = [r.path for r in rep["selected"].where("task_id = 1").orderBy("running_tokens").collect()]
    assert sel == ["pkg/__init__.py", "pkg/broken.py"]  # models.py (164 tokens) overflows
    b = {r.task_id: (r.used, r.remaining) for r in rep["budget"].collect()}
    assert b == {1: (16, 84), 2: (0, 100)}


def test_cli_writes_every_section(spark, tmpdir_path):
    import os
    import tempfile
    from quarry.cli import run
    root = write_tree(tempfile.mkdtemp(prefix="quarry-cli-"), TREE)
    out = os.path.join(tmpdir_path, "conv")
    rep = run(["conventions", root, "--out", out])
    assert sorted(os.listdir(out)) == sorted(rep)
    assert spark.read.json(os.path.join(out, "counts")).count() == 2


def test_materialized_corpus_same_results(spark, tmpdir_path):
    import os
    import tempfile
    root = write_tree(tempfile.mkdtemp(prefix="quarry-mat-"), TREE)
    c = R.scan(spark, root, facts_path=os.path.join(tmpdir_path, "facts"),
               files_path=os.path.join(tmpdir_path, "files"))
    s = {r.repo: (r.n_modules, r.n_classes, r.n_functions) for r in R.arch_report(c)["structure"].collect()}
    assert s["repoA"] == (4, 3, 3)
    assert os.path.isdir(os.path.join(tmpdir_path, "facts", "kind=module"))


def test_import_existence_checks_whole_tree(spark):
    import tempfile
    # b.py lives under an excluded folder: not scanned, but it exists, so the
    # import is local; the edge guard passes because the scanned bu.py's
    # module name is a character prefix of build.b
    root = write_tree(tempfile.mkdtemp(prefix="quarry-exist-"),
                      {"r/a.py": "import build.b\n", "r/bu.py": "", "r/build/b.py": "x = 1\n"})
    c = R.scan(spark, root, exclude=["build/**"])
    e = {(x.src, x.dst) for x in R.deps_report(c)["edges"].collect()}
    assert e == {("a", "build.b")}
