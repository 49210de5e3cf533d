"""All reports over a real code corpus: the interpreter's standard library
(test and site-packages folders excluded). Cycles are checked against a
brute-force search on the same edges."""

import os
import sysconfig

import pytest

from quarry.plans import reports as R

STDLIB = sysconfig.get_paths()["stdlib"]
EXCLUDE = ["**/site-packages/**", "site-packages/**", "**/test/**", "test/**", "**/tests/**", "tests/**"]


@pytest.fixture(scope="module")
def corpus(spark):
    if not os.path.isdir(STDLIB):
        pytest.skip("no stdlib sources")
    return R.scan(spark, STDLIB, exclude=EXCLUDE, repo_level=0)


def test_every_report_runs(corpus, spark):
    tasks = spark.createDataFrame([(1, os.path.basename(STDLIB), "fix the email parser error")],
                                  "task_id long, repo string, text string")
    reports = [R.arch_report(corpus), R.patterns_report(corpus), R.coverage_report(corpus),
               R.conventions_report(corpus), R.context_report(corpus, tasks, 5000)]
    for rep in reports:
        for df in rep.values():
            df.write.format("noop").mode("overwrite").save()
    s = reports[0]["structure"].collect()[0]
    assert s.n_modules > 100 and s.n_classes > 100


def test_cycles_match_brute_force(corpus):
    rep = R.deps_report(corpus, max_cycle_len=4)
    edges = [(r.src, r.dst) for r in rep["edges"].collect()]
    got = {tuple(r.nodes) for r in rep["cycles"].collect()}
    adj = {}
    for s, d in edges:
        adj.setdefault(s, set()).add(d)
    want = set()

    def dfs(start, path):
        for nx in adj.get(path[-1], ()):
            if nx == start:
                want.add(tuple(path))
            elif nx > start and nx not in path and len(path) < 4:
                dfs(start, path + [nx])
    for n in sorted(adj):
        dfs(n, [n])
    assert got == want and len(want) > 0
