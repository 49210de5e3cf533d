"""Files read by byte ranges, and documents written by many tasks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import coverage as CV
from quarry.sources import corpus, ranges, reports
from test_sources import COV_XML
from trees import write_tree

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def odd_files():
    rng = random.Random(4)
    piece = lambda: rng.choice([*BREAKS, *BREAKS, "a", "é", "€", "😀", "\x7f", "word " * 3, ""])
    files = {f"r{k % 3}/f{k}.py": "".join(piece() for _ in range(rng.randrange(0, 60))) for k in range(60)}
    return files | {"r0/empty.py": "", "r0/one.py": "\n", "r1/cr.py": "\r\r\n\n", "r1/end.py": "x\r\n", "r2/open.py": "x" * 300}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_lines_by_ranges_are_those_of_splitlines(spark, tmpdir_path, size):
    files = odd_files()
    write_tree(tmpdir_path, files | {"r0/bad.py": b"ok\n\xff\xfe", "r0/cut.py": b"a\nb\xe2\x80", "r0/cont.py": b"a\n\x80\x80\x80\x80\nb"})
    paths = corpus.glob_filter(corpus.list_paths(spark, tmpdir_path))
    got = {}
    for r in ranges.scan_lines(tmpdir_path, paths, size).collect():
        assert got.setdefault((f"{r.repo}/{r.path}", r.line_no), r.line) == r.line
    want = {(p, n + 1): line for p, text in files.items() for n, line in enumerate(text.splitlines())}
    assert got == want


def test_files_are_packed_by_size(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(ranges, "OPEN_BYTES", 10)
    write_tree(tmpdir_path, {f"r/f{k}.py": "x" * (5000 if k == 7 else 90) for k in range(40)})
    paths = corpus.list_paths(spark, tmpdir_path)
    dealt = ranges.packed(paths, "size", ["abs"], 1000).select(F.spark_partition_id().alias("p"), "size").collect()
    load = {}
    for r in dealt:
        load[r.p] = load.get(r.p, 0) + r.size + 10
    assert len(dealt) == 40 and len(load) >= 4 and max(load.values()) <= 5010 + 2000
    assert corpus.scan_corpus(spark, tmpdir_path).count() == 40


def test_a_long_line_over_many_ranges(spark, tmpdir_path):
    text = "a\n" + "b" * 3_000_000 + "\nc\n" + "\n" * 5000
    write_tree(tmpdir_path, {"r/f.py": text})
    rows = ranges.scan_lines(tmpdir_path, corpus.list_paths(spark, tmpdir_path), 1 << 16)
    assert {r.line_no: r.n for r in rows.select("line_no", F.length("line").alias("n")).where("n > 0").collect()} == {1: 1, 2: 3_000_000, 3: 1}
    assert rows.count() == len(text.splitlines())


@pytest.mark.parametrize("size", [16, 200, 1 << 20])
def test_coverage_by_ranges_is_the_whole_report(spark, tmpdir_path, size):
    more = COV_XML.replace("part.py", "b.py").replace("dup.py", "zero.py") + "<class filename='cut.py'><lines>"
    write_tree(tmpdir_path, {"r/a.xml": COV_XML, "r/b.xml": more, "q/only.xml": "<coverage><class filename='x.py'/></coverage>"})
    found = ranges.scan_coverage_ranges(tmpdir_path, corpus.list_paths(spark, tmpdir_path), size)
    per = {(r.repo, r.filename): (r.lines_covered, r.lines_total, r.line_rate, list(r.uncovered_lines))
           for r in CV.coverage_per_file(found).collect()}
    whole = reports.scan_coverage_xml(spark, os.path.join(tmpdir_path, "r/a.xml"), repo="r")
    want = {(r.repo, r.filename): (r.lines_covered, r.lines_total, r.line_rate, list(r.uncovered_lines))
            for r in CV.coverage_per_file(whole).collect()}
    # the later file's elements win
    want |= {("r", "b.py"): want["r", "part.py"], ("r", "zero.py"): (1, 2, 0.9, [2]), ("q", "x.py"): (0, 0, 0.0, [])}
    assert per == want


def test_documents_of_a_hot_key_are_written_by_many_tasks(spark, tmpdir_path):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN concat('k', id % 3) ELSE 'hot' END AS key", "id AS n",
                                        "concat('\"é]', id) AS said", "CAST(NULL AS STRING) AS none")
    out = os.path.join(tmpdir_path, "docs")
    reports.write_documents(rows.repartition(7), out, "key", ["n"])
    want = {}
    for r in rows.collect():
        want.setdefault(r.key, []).append({"n": r.n, "said": r.said})
    for key, items in want.items():
        folder = os.path.join(out, f"key={key}")
        parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
        document = "".join(open(os.path.join(folder, p)).read() for p in parts)
        assert json.loads(document) == sorted(items, key=lambda i: i["n"])
        assert key != "hot" or len(parts) >= 3
    back = reports.read_documents(spark, out, "n long, said string")
    assert sorted(map(tuple, back.collect())) == sorted((r.key, r.n, r.said) for r in rows.collect())
