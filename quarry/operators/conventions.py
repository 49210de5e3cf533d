"""Convention rules (H1-H13): violations, counts, consistency scores.

Violations share one flat schema:
``repo, path, line, category, severity, rule, actual, cat_ord, rule_ord``.
``cat_ord``/``rule_ord`` reproduce the original tool's per-file emission order
(naming, imports, style, docstrings, type hints) for "first N" listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import Rule, findings

# Categories and severities of the rules.
CATEGORIES = ["naming", "imports", "style", "docstrings", "type_hints"]
SEVERITY_ORDER = {"error": 2, "warning": 1, "info": 0}

VIOLATION_COLS = ["repo", "path", "line", "category", "severity", "rule",
                  "actual", "cat_ord", "rule_ord"]


def _v(df: DataFrame, line, category: str, severity: str, rule: str, rule_ord: int,
       actual=None) -> DataFrame:
    return df.select(
        "repo", "path",
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        (actual if actual is not None else F.lit(None)).cast("string").alias("actual"),
        F.lit(CATEGORIES.index(category)).alias("cat_ord"),
        F.lit(rule_ord).alias("rule_ord"),
    )


def rule_function_name(functions: DataFrame) -> DataFrame:
    """H1: top-level function names that are not snake_case (``_x`` exempt)."""
    bad = functions.where(~T.is_snake_case("name") & ~F.col("name").startswith("_"))
    return _v(bad, F.col("line"), "naming", "warning", "Function naming", 0, F.col("name"))


def rule_class_name(classes: DataFrame) -> DataFrame:
    """H2: class names that are not PascalCase."""
    bad = classes.where(~T.is_pascal_case("name"))
    return _v(bad, F.col("line"), "naming", "warning", "Class naming", 1, F.col("name"))


def rule_constant_name(constants: DataFrame) -> DataFrame:
    """H3: constants that are not str.isupper() (no line is reported)."""
    bad = constants.where(~T.is_upper("name"))
    return _v(bad, None, "naming", "info", "Constant naming", 2, F.col("name"))


def rule_import_grouping(imports: DataFrame, min_imports: int = 5) -> DataFrame:
    """H4: more than ``min_imports`` imports whose sorted lines are all
    consecutive (no blank line between groups); reported at the first one.

    Sorted lines have every gap equal to 1 exactly when they are distinct
    and span ``count - 1``; that is a plain aggregation (the distinct count
    is planned as a two-level aggregate), so no per-file sort is needed.
    """
    g = (imports.groupBy("repo", "path")
         .agg(F.count(F.lit(1)).alias("n"),
              F.min("line").alias("lo"), F.max("line").alias("hi"),
              F.count_distinct("line").alias("nd")))
    bad = g.where((F.col("n") > min_imports) & (F.col("n") > 1)
                  & (F.col("hi") - F.col("lo") == F.col("n") - 1)
                  & (F.col("nd") == F.col("n")))
    return _v(bad, F.col("lo"), "imports", "info", "Import grouping", 0,
              F.col("n").cast("string"))


def rule_line_length(lines: DataFrame, max_len: int = 100) -> DataFrame:
    """H5: lines longer than ``max_len`` characters that are not comments."""
    n = F.length("line")
    bad = lines.where((n > max_len) & ~T.lstrip_py("line").startswith("#"))
    return _v(bad, F.col("line_no"), "style", "info", "Line length", 0,
              F.concat(n.cast("string"), F.lit(" chars")))


def rule_docstrings(modules: DataFrame, classes: DataFrame | None = None,
                    functions: DataFrame | None = None) -> DataFrame:
    """H6: missing (null or empty) docstrings of modules, classes and public
    top-level functions."""
    missing = lambda: F.coalesce(F.col("docstring"), F.lit("")) == ""
    out = _v(modules.where(missing()), F.lit(1), "docstrings", "info", "Module docstring", 0)
    if classes is not None:
        out = out.unionByName(_v(classes.where(missing()), F.col("line"), "docstrings", "info",
                                 "Class docstring", 1, F.col("name")))
    if functions is not None:
        f = functions.where(missing() & ~F.col("name").startswith("_"))
        out = out.unionByName(_v(f, F.col("line"), "docstrings", "info",
                                 "Function docstring", 2, F.col("name")))
    return out


def rule_return_hint(functions: DataFrame, required: bool = False) -> DataFrame:
    """H7: public functions without a return annotation (off by default)."""
    f = functions.where(F.col("returns").isNull() & ~F.col("name").startswith("_"))
    if not required:
        f = f.where(F.lit(False))
    return _v(f, F.col("line"), "type_hints", "info", "Function return type", 0, F.col("name"))


def violations(*parts: DataFrame) -> DataFrame:
    """H8: all rule outputs as one table."""
    out = parts[0].select(*VIOLATION_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*VIOLATION_COLS))
    return out


def name_rules(names: DataFrame, function_if=None, class_if=None, constant_if=None) -> DataFrame:
    """H1-H3 over one table of names in a single pass.

    ``names(repo, path, line, name)``; each ``*_if`` is a boolean column
    saying which names play that role (None: rule not applied). Every row
    yields the violations of its roles through one projection and explode,
    so the names are read once whatever the number of rules.
    """
    nm = F.col("name")

    def v(cond, severity, rule, rule_ord, line):
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                     F.lit(rule_ord).alias("rule_ord"), line.cast("int").alias("line")))

    cands = []
    if function_if is not None:
        cands.append(v(function_if & ~T.is_snake_case(nm) & ~nm.startswith("_"), "warning",
                       "Function naming", 0, F.col("line")))
    if class_if is not None:
        cands.append(v(class_if & ~T.is_pascal_case(nm), "warning", "Class naming", 1, F.col("line")))
    if constant_if is not None:
        cands.append(v(constant_if & ~T.is_upper(nm), "info", "Constant naming", 2, F.lit(None)))
    x = names.select("repo", "path", "name", F.explode(F.array_compact(F.array(*cands))).alias("v"))
    return x.select("repo", "path", F.col("v.line").alias("line"), F.lit("naming").alias("category"),
                    "v.severity", "v.rule", F.col("name").alias("actual"),
                    F.lit(0).alias("cat_ord"), "v.rule_ord")


def severity_rank(c="severity"):
    x = T.as_col(c)
    return (F.when(x == "error", 2).when(x == "warning", 1).otherwise(0))


def severity_filter(v: DataFrame, minimum: str = "warning") -> DataFrame:
    """H9: keep severity >= minimum; an unknown minimum keeps everything."""
    m = SEVERITY_ORDER.get(minimum, 0)
    return v.where(severity_rank() >= m)


def first_violations(v: DataFrame, n: int = 100) -> DataFrame:
    """H9 listing: the first ``n`` violations of each repo in file order.

    Planned as a per-repo ``WindowGroupLimit``: each map task keeps at most
    ``n`` rows per repo before the shuffle, so a huge repo is cut early.
    """
    w = Window.partitionBy("repo").orderBy(
        T.path_sort_key("path"), "cat_ord", "rule_ord", F.col("line").asc_nulls_first(),
        "actual")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def violation_counts(all_violations: DataFrame, files: DataFrame,
                     minimum: str = "warning") -> DataFrame:
    """Per repo, counts by category before the severity filter, by
    severity after it (``minimum``), and the number of files.

    One aggregation over the violations (partial aggregation in the map
    tasks, so a hot repo costs one row per task) joined to the per-repo file
    count.
    """
    shown = severity_rank() >= SEVERITY_ORDER.get(minimum, 0)
    agg = all_violations.groupBy("repo").agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES],
        F.count_if(shown).alias("total_violations"),
        *[F.count_if(shown & (F.col("severity") == s)).alias(s) for s in ("error", "warning", "info")])
    nfiles = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))
    out = (nfiles.join(agg, "repo", "left")
           .na.fill(0, CATEGORIES + ["total_violations", "error", "warning", "info"]))
    return out.withColumn("category_total", sum(F.col(c) for c in CATEGORIES))


def consistency(counts: DataFrame) -> DataFrame:
    """overall = max(0, 100 - int(S / (S + files) * 100)); per category
    100 - int(count / max(1, files) * 100) (may be negative)."""
    s = F.col("category_total")
    checks = F.greatest(F.lit(1), s + F.col("n_files"))
    overall = F.greatest(F.lit(0), F.lit(100) - (s / checks * 100).cast("int"))
    cats = [(F.lit(100) - (F.col(c) / F.greatest(F.lit(1), F.col("n_files")) * 100)
             .cast("int")).alias(f"{c}_score") for c in CATEGORIES]
    return counts.select("repo", "n_files", "category_total", "total_violations",
                         overall.alias("overall"), *cats)


def infer_convention(names: DataFrame, files: DataFrame, kind: str,
                     sample_files: int = 20, min_share: float = 0.8,
                     n_examples: int = 3) -> DataFrame:
    """Within the first ``sample_files`` files of each repo (path
    order), the share of names following the convention; emitted when the
    share exceeds ``min_share``.

    ``names(repo, path, seq, name)``; ``kind`` is ``function`` (snake_case)
    or ``class`` (PascalCase). Sampled files come from a per-repo top-k
    (``WindowGroupLimit``), joined back to names on (repo, path).
    """
    w = Window.partitionBy("repo").orderBy(T.path_sort_key("path"))
    sample = (files.select("repo", "path")
              .withColumn("file_rank", F.row_number().over(w))
              .where(F.col("file_rank") <= sample_files))
    pred = T.is_snake_case("name") if kind == "function" else T.is_pascal_case("name")
    pattern = "snake_case" if kind == "function" else "PascalCase"
    rule = "Function naming" if kind == "function" else "Class naming"
    j = names.join(sample, ["repo", "path"], "left_semi")
    agg = j.groupBy("repo").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_if(pred).alias("matching"))
    wx = Window.partitionBy("repo").orderBy(T.path_sort_key("path"), "seq")
    examples = (j.withColumn("ex_rank", F.row_number().over(wx))
                .where(F.col("ex_rank") <= n_examples)
                .groupBy("repo")
                .agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("ex_rank", "name"))),
                    lambda s: s["name"]), ",").alias("examples")))
    share = F.col("matching") / F.col("occurrences")
    return (agg.where((F.col("occurrences") > 0) & (share > min_share))
            .join(examples, "repo", "left")
            .select("repo", F.lit("naming").alias("category"), F.lit(rule).alias("rule"),
                    F.lit(pattern).alias("pattern"), share.alias("confidence"),
                    "occurrences", "examples"))


# The thresholds of the conventions findings.
CONVENTION_RULES = [
    Rule("low_consistency", "overall", "<", 70),
    Rule("good_consistency", "overall", "<", 90, when="overall >= 70"),
    Rule("naming_inconsistencies", "naming", ">", 10),
    Rule("missing_docstrings", "docstrings", ">", 20),
    Rule("style_violations", "style", ">", 15),
    Rule("high_consistency", "overall", ">=", 90),
]


def findings_conventions(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Consistency band and category counts above their thresholds."""
    s = scores.select("repo", "overall").join(
        counts.select("repo", *CATEGORIES), "repo")
    return findings(s, "conventions", CONVENTION_RULES)
