"""Dictionaries as tables and prefix search against plain Python and the literal forms."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import context as CX
from quarry.operators import dictionary as D
from quarry.operators import frameworks as FW
from quarry.operators import patterns as P
from quarry.operators.prefixes import starting_with


def test_prefix_table_is_the_literal_form(spark):
    names = ["pandas", "pd.x", "numpyx", "torch.nn", "st", "stream", "", None, "Flask", "zz", "matplotlib.pyplot", "p"]
    imports = spark.createDataFrame([("r", f"f{k % 3}.py", n) for k, n in enumerate(names * 2)], "repo string, path string, module string")
    table = D.literal_dictionary(spark, FW.FRAMEWORK_PREFIXES)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.match_prefixes(imports, table)) == rows(FW.match_prefix_dict(imports)) != []
    assert rows(D.match_prefixes(imports, table.limit(0))) == []
    every = spark.createDataFrame([("all", "", 0), ("none", None, 1)], "key string, token string, ord long")
    assert {r.framework for r in D.match_prefixes(imports, every).collect()} == {"all"}


@pytest.mark.parametrize("part", [100_000, 3])
def test_token_tables_are_the_literal_forms(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART_TOKENS", part)
    rng = random.Random(part)
    bits = ["pd.", "np.", "merge", "concat", "pivot", "melt", "groupby", "read_csv", " ", "x", "é", "DataFrame"]
    lines = spark.createDataFrame([("r", "f.py", k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))) for k in range(300)]
                                  + [("r", "g.py", 1, None)], "repo string, path string, line_no int, line string")
    table = lambda tokens: D.literal_dictionary(spark, {"t": tokens})
    got = D.first_token_table(lines, table(P.DATAFRAME.tokens * 2), table(P.DATAFRAME.guards), "dataframe")
    want = P.first_token_match(lines, P.DATAFRAME)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    tasks = spark.createDataFrame([(1, "Plot the CSV"), (2, "HTML api"), (3, ""), (4, None), (5, "nothing")], "task_id int, text string")
    found = {r.task_id: list(r.keywords) for r in D.keywords_table(tasks, table(CX.DEFAULT_KEYWORDS)).collect()}
    assert found == {r.task_id: list(r.k or []) for r in tasks.select("task_id", CX.task_keywords("text").alias("k")).collect()}
    assert D.keywords_table(tasks, table(["x"]).limit(0)).count() == 5


def test_a_dictionary_of_100000_tokens(spark):
    table = spark.range(100_000).selectExpr("concat('k', id % 7) AS key", "concat('tok', id, '_') AS token", "id AS ord")
    lines = spark.createDataFrame([("r", "f", k, f"a tok{k * 999 + 5}_ b tok{k}_ ") for k in range(100)],
                                  "repo string, path string, line_no int, line string")
    got = {r.line: r.operation for r in D.first_token_table(lines, table, None, "t").collect()}
    assert got == {k: f"tok{k}_" for k in range(100)}
    names = lines.select("repo", "path", F.concat(F.lit("tok"), F.col("line_no") * 7, F.lit("_x")).alias("module"))
    assert {r.framework for r in D.match_prefixes(names, table).collect()} == {"k0"}


@pytest.mark.parametrize("part,known", [(100_000, 200_000), (4, 2)])
def test_prefixes_are_looked_up_without_dealing_out_names(spark, monkeypatch, part, known):
    monkeypatch.setattr(D, "PART_TOKENS", part)
    monkeypatch.setattr(D, "KNOWN_NAMES", known)
    rng = random.Random(part)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    entries = [(rng.choice(["x", "y", "z", None]), word(5) or None) for _ in range(12)] + [("w", "a"), ("v", "a"), (None, "bb")]
    table = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(entries)], "key string, token string, ord long")
    rows = [(rng.choice(["r", "s", None]), rng.choice(["f", "g", None, "h"]), rng.choice([word(8), word(8), None])) for _ in range(400)]
    imports = spark.createDataFrame(rows, "repo string, path string, module string").repartition(3)
    got = D.match_prefixes(imports, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # nothing but the files' keys is dealt out
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = {(r, p, k) for r, p, m in rows if m for k, t in entries if t is not None and m.startswith(t)}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert D.match_prefixes(imports, table.where("token IS NULL")).collect() == []


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_strings_that_start_with_a_name(spark, slices):
    rng = random.Random(slices)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(rng.randrange(n)))
    names = [("r", "abab"), ("r", "abab.a"), ("r", "b"), ("q", "b."), ("e", ""), (None, "a"), ("r", None)]
    names += [("s", word(5) + "b") for _ in range(6)]
    targets = [(g, word(9)) for g in "rqsez" for _ in range(120)] + [("r", "abab"), ("r", None), (None, "a")]
    got = starting_with(spark.createDataFrame(targets, "repo string, dst string").repartition(5),
                        spark.createDataFrame(names, "repo string, n string"), "repo", "dst", "n", slices)
    want = {(g, t) for g, t in targets if g and t is not None and any(h == g and n is not None and t.startswith(n) for h, n in names)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
