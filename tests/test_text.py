"""Line splitting, glob dialects, module keys and path order."""

import fnmatch
import os
import tempfile
from pathlib import Path, PurePosixPath

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import corpus

SAMPLES = ["", "a", "a\n", "a\nb", "a\nb\n", "a\r\nb", "a\rb\r", "a\x0cb", "a\x0bb\x1cc",
           "a\x85b", "a b ", "\n", "\n\n", "a\n\nb\n\n", "x\r\n\r\ny", "tail\r"]


def test_splitlines_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: list(r.lines) for r in df.select("i", T.splitlines("s").alias("lines")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == s.splitlines(), repr(s)


def test_line_table_numbering(spark):
    files = spark.createDataFrame([("r", "a.py", "x\n\ny\n")], "repo string, path string, content string")
    rows = corpus.line_table(files).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(1, "x"), (2, ""), (3, "y")]


PATHS = ["a.py", "venv/x.py", "src/venv/y.py", "test_a.py", "pkg/test_b.py", "pkg/sub/c.py",
         "pkg/c.txt", "build/z.py", "deep/a/b/c/d.py", "x/.git/h.py", "pkg/[a].py"]


@pytest.mark.parametrize("pattern", ["**/venv/**", "**/test_*.py", "*.py", "pkg/*", "build/**",
                                     "**/.git/**", "pkg/?.txt", "pkg/[!a]*"])
def test_fnmatch_dialect(spark, pattern):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r.path for r in df.where(F.col("path").rlike(T.fnmatch_regex(pattern))).collect()}
    assert got == {p for p in PATHS if fnmatch.fnmatch(p, pattern)}


@pytest.mark.parametrize("pattern", ["**/*.py", "*.py", "pkg/*.py", "pkg/**/*.py", "deep/**/d.py",
                                     "**/c.*", "*/*.py"])
def test_pathlib_glob_dialect(spark, pattern):
    root = tempfile.mkdtemp(prefix="quarry-glob-")
    for p in PATHS:
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        open(full, "w").close()
    expected = {str(q.relative_to(root)) for q in Path(root).glob(pattern) if q.is_file()}
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r.path for r in df.where(F.col("path").rlike(T.pathlib_glob_regex(pattern))).collect()}
    assert got == expected


def test_default_excludes_keep_top_level_venv(spark):
    df = spark.createDataFrame([("r", p, "") for p in PATHS], "repo string, path string, content string")
    got = {r.path for r in corpus.glob_filter(df).collect()}
    assert "venv/x.py" in got and "src/venv/y.py" not in got
    assert "x/.git/h.py" not in got and "build/z.py" in got  # fnmatch needs a '/' before build


def test_module_key(spark):
    cases = {"a/b.py": "a.b", "a/b/__init__.py": "a.b", "__init__.py": "", "x.py": "x",
             "my__init__.py": "my__init__"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r.path: r.m for r in df.select("path", T.module_key("path").alias("m")).collect()}
    assert got == cases


def test_path_order_is_parts_order(spark):
    paths = ["a-b/x.py", "a/b.py", "a/b/c.py", "a.py", "a b.py", "ab/c.py", "a/b-c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in df.orderBy(T.path_sort_key("path")).collect()]
    assert got == [str(p) for p in sorted(PurePosixPath(p) for p in paths)]


def test_isupper_and_case_rules(spark):
    names = ["ABC", "A_1", "abc", "Abc", "_", "1", "ÉTÉ", "ß"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.u for r in df.select("n", T.is_upper("n").alias("u")).collect()}
    assert got == {n: n.isupper() for n in names}
