"""Edge cases of single rules, with expectations from the semantics."""


from quarry.operators import conventions as C
from quarry.operators import patterns as P
from quarry.operators.findings import Rule, findings


def _imports(spark, files):
    rows = [("r", path, i, line) for path, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "repo string, path string, seq long, line int")


def test_import_grouping_edges(spark):
    imp = _imports(spark, {
        "six_consecutive.py": [1, 2, 3, 4, 5, 6],
        "five_consecutive.py": [1, 2, 3, 4, 5],
        "duplicate_line.py": [1, 1, 2, 3, 4, 5],      # `import a, b` on one line: gap 0
        "blank_between.py": [1, 2, 3, 5, 6, 7],
        "unsorted.py": [6, 5, 4, 3, 2, 1],
    })
    got = {r.path: r.line for r in C.rule_import_grouping(imp).collect()}
    assert got == {"six_consecutive.py": 1, "unsorted.py": 1}


def test_line_length_and_comments(spark):
    lines = spark.createDataFrame(
        [("r", "a.py", 1, "x" * 101), ("r", "a.py", 2, "    # " + "c" * 100), ("r", "a.py", 3, "y" * 100),
         ("r", "a.py", 4, "\t#" + "z" * 120)], "repo string, path string, line_no int, line string")
    got = {r.line: r.actual for r in C.rule_line_length(lines).collect()}
    assert got == {1: "101 chars"}


def test_severity_filter_levels(spark):
    v = spark.createDataFrame([("r", "a.py", 1, "naming", "warning", "x", "n", 0, 0),
                               ("r", "a.py", 2, "style", "info", "y", "s", 2, 0),
                               ("r", "a.py", 3, "naming", "error", "z", "e", 0, 0)],
                              ", ".join(f"{c} {t}" for c, t in zip(C.VIOLATION_COLS, [
                                  "string", "string", "int", "string", "string", "string", "string",
                                  "int", "int"])))
    assert C.severity_filter(v, "error").count() == 1
    assert C.severity_filter(v, "warning").count() == 2
    assert C.severity_filter(v, "info").count() == 3
    assert C.severity_filter(v, "bogus").count() == 3  # unknown minimum keeps everything


def test_findings_ok_row(spark):
    s = spark.createDataFrame([("a", 5), ("b", 50)], "repo string, x int")
    got = sorted((r.repo, r.rule) for r in findings(s, "t", [Rule("big", "x", ">", 10)]).collect())
    assert got == [("a", "ok"), ("b", "big")]


def test_type_filter_aliases(spark):
    hits = spark.createDataFrame([("r", "a.py", 1, "visualization", None), ("r", "a.py", 2, "context_manager", None),
                                  ("r", "a.py", 3, "async", None)],
                                 "repo string, path string, line int, type string, operation string")
    assert {r.type for r in P.type_filter(hits, ["viz", "context"]).collect()} == {"visualization", "context_manager"}
    assert P.type_filter(hits, None).count() == 3


def test_pipeline_before_model(spark):
    lines = spark.createDataFrame([("r", "a.py", 1, "p = Pipeline(); p.fit(x)"), ("r", "a.py", 2, "m.fit_transform(x)"),
                                   ("r", "a.py", 3, "m.predict(x)")], "repo string, path string, line_no int, line string")
    got = {r.line: r.type for r in P.ml_usage_lines(lines).collect()}
    assert got == {1: "pipeline", 3: "model"}  # .fit_transform( alone is not a model call


def test_first_token_in_list_order(spark):
    lines = spark.createDataFrame([("r", "a.py", 1, "df = pd.concat([a.merge(b)])")],
                                  "repo string, path string, line_no int, line string")
    assert [r.operation for r in P.first_token_match(lines, P.DATAFRAME).collect()] == ["merge"]
