"""Coverage gaps (G1-G9): coverage records joined to files, prioritised.

``coverage(repo, filename, line_no, hits[, line_rate, doc_pos])`` is one row
per reported line (see :func:`quarry.sources.reports.scan_coverage_xml`).
Everything is aggregated per file first; lists (uncovered lines, blocks)
are per file, never per repo.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import Rule, findings


@dataclass(frozen=True)
class GapPolicy:
    """Thresholds and path tokens of the gap priority and reasons.

    The defaults are the original tool's fixed values.
    """
    lines_threshold: float = 80.0
    core_tokens: list[str] = field(default_factory=lambda: ["utils", "lib", "core", "services", "models"])
    important_tokens: list[str] = field(default_factory=lambda: ["api", "views", "handlers"])
    reason_core_tokens: list[str] = field(default_factory=lambda: ["util", "lib", "core"])
    reason_api_tokens: list[str] = field(default_factory=lambda: ["api", "view"])
    critical_complexity: int = 30
    high_complexity: int = 50
    low_rate: float = 0.5


def resolve_last_wins(coverage: DataFrame) -> DataFrame:
    """Repeated filename in a report: keep the records of the last class
    element (highest ``doc_pos``); a no-op without ``doc_pos``."""
    if "doc_pos" not in coverage.columns:
        return coverage
    last = coverage.groupBy("repo", "filename").agg(F.max("doc_pos").alias("doc_pos"))
    return coverage.join(last, ["repo", "filename", "doc_pos"], "left_semi")


def coverage_per_file(coverage: DataFrame) -> DataFrame:
    """G1: lines total / covered, uncovered line numbers in order, and the
    line rate (as reported if given, else covered/total).

    Optional columns of the XML source are honoured: ``has_line`` (a class
    without lines still yields its file) and ``covered`` (else hits != 0).
    """
    cov = resolve_last_wins(coverage)
    has_rate = "line_rate" in cov.columns
    is_line = F.col("has_line") if "has_line" in cov.columns else F.lit(True)
    covered = F.col("covered") if "covered" in cov.columns else (F.col("hits") != 0)
    aggs = [F.count_if(is_line).alias("lines_total"),
            F.count_if(is_line & covered).alias("lines_covered"),
            F.array_sort(F.collect_list(F.when(is_line & ~covered, F.col("line_no")))).alias("uncovered_lines")]
    if has_rate:
        aggs.append(F.max("line_rate").alias("reported_rate"))
    g = cov.groupBy("repo", "filename").agg(*aggs)
    computed = F.when(F.col("lines_total") > 0, F.col("lines_covered") / F.col("lines_total")).otherwise(F.lit(0.0))
    rate = F.col("reported_rate") if has_rate else computed
    return g.select("repo", "filename", "lines_covered", "lines_total", rate.alias("line_rate"),
                    "uncovered_lines")


def join_coverage(files: DataFrame, per_file: DataFrame) -> DataFrame:
    """Every file with its coverage; files absent from the report get
    zeros and an empty uncovered list (exact path lookup)."""
    j = files.select("repo", "path").join(
        per_file.withColumnRenamed("filename", "path"), ["repo", "path"], "left")
    return j.select("repo", "path",
                    F.coalesce("lines_covered", F.lit(0)).alias("lines_covered"),
                    F.coalesce("lines_total", F.lit(0)).alias("lines_total"),
                    F.coalesce("line_rate", F.lit(0.0)).alias("line_rate"),
                    F.coalesce("uncovered_lines", F.array().cast("array<int>")).alias("uncovered_lines"))


def _any(path_lower, tokens):
    c = F.lit(False)
    for t in tokens:
        c = c | path_lower.contains(t)
    return c


def gap_priority(policy: GapPolicy):
    """Critical / high / medium / low from rate, complexity, location."""
    p = F.lower(F.col("path"))
    rate, cx = F.col("line_rate"), F.col("complexity")
    thr = policy.lines_threshold / 100
    core, imp = _any(p, policy.core_tokens), _any(p, policy.important_tokens)
    return (F.when(core & (rate == 0) & (cx > policy.critical_complexity), "critical")
            .when(core & (rate < thr), "critical")
            .when(imp & (rate < policy.low_rate), "high")
            .when((cx > policy.high_complexity) & (rate < policy.low_rate), "high")
            .when(rate < thr, "medium")
            .otherwise("low"))


def gap_reasons(policy: GapPolicy):
    """Ordered reason codes (coverage, complexity, location)."""
    p = F.lower(F.col("path"))
    rate, cx = F.col("line_rate"), F.col("complexity")
    thr = policy.lines_threshold / 100
    return F.array_compact(F.array(
        F.when(rate == 0, F.lit("no_coverage")).when(rate < thr, F.lit("below_threshold")),
        F.when(cx > policy.high_complexity, F.lit("very_high_complexity"))
         .when(cx > policy.critical_complexity, F.lit("high_complexity")),
        F.when(_any(p, policy.reason_core_tokens), F.lit("core_utility"))
         .when(_any(p, policy.reason_api_tokens), F.lit("api_layer")),
    ))


PRIORITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def priority_ordinal(c="priority"):
    x = T.as_col(c)
    return (F.when(x == "critical", 0).when(x == "high", 1).when(x == "medium", 2)
            .when(x == "low", 3).otherwise(4))


def assess_files(joined: DataFrame, blocks: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """Per file: coverage, total complexity, priority, reasons, gap flag."""
    cx = blocks.groupBy("repo", "path").agg(F.sum("complexity").cast("long").alias("complexity"))
    j = joined.join(cx, ["repo", "path"], "left").na.fill(0, ["complexity"])
    thr = policy.lines_threshold / 100
    return j.select("*", gap_priority(policy).alias("priority"), gap_reasons(policy).alias("reasons"),
                    ((F.col("line_rate") < thr) | (F.col("line_rate") == 0)).alias("is_gap"))


def gap_filter(assessed: DataFrame, priority: str = "all") -> DataFrame:
    """G4 (+ optional priority equality)."""
    g = assessed.where("is_gap")
    return g if priority == "all" else g.where(F.col("priority") == priority)


def gap_functions(gaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """All blocks of each gap file as ``(name, complexity, line)`` in
    line order (a per-file list)."""
    b = (blocks.join(gaps.select("repo", "path"), ["repo", "path"], "left_semi")
         .groupBy("repo", "path")
         .agg(F.array_sort(F.collect_list(F.struct("line", "name", "complexity"))).alias("functions")))
    return gaps.join(b, ["repo", "path"], "left").withColumn(
        "functions", F.coalesce("functions", F.array().cast(b.schema["functions"].dataType)))


def gap_rank(gaps: DataFrame, k: int = 50, critical_k: int = 10) -> DataFrame:
    """Order critical < high < medium < low, then complexity desc, then
    path; keep the first ``k`` per repo and flag the first ``critical_k``
    critical ones. Per-repo WindowGroupLimit."""
    w = Window.partitionBy("repo").orderBy(priority_ordinal(), F.col("complexity").desc(),
                                           T.path_sort_key("path"))
    r = gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # critical rows come first, so the first critical_k critical rows have rank <= critical_k
    return r.withColumn("in_critical_list",
                        (F.col("priority") == "critical") & (F.col("rank") <= critical_k))


def coverage_summary(assessed: DataFrame, gaps: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Overall line coverage %, tested / untested files, gap count.

    ``total_files`` counts all scanned ``files`` where they are given, those
    that do not parse included, else the assessed ones."""
    s = assessed.groupBy("repo").agg(
        F.sum("lines_covered").cast("long").alias("covered"),
        F.sum("lines_total").cast("long").alias("total"),
        F.count_if(F.col("line_rate") > 0).alias("tested_files"),
        F.count_if(~(F.col("line_rate") > 0)).alias("untested_files"),
        F.count(F.lit(1)).alias("total_files"))
    if files is not None:
        counted = ["covered", "total", "tested_files", "untested_files"]
        s = (files.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"))
             .join(s.drop("total_files"), "repo", "left").na.fill(0, counted))
    g = gaps.groupBy("repo").agg(F.count(F.lit(1)).alias("gap_files"),
                                 F.count_if(F.col("priority") == "critical").alias("critical_gaps"),
                                 F.count_if(F.col("complexity") > 50).alias("complex_gaps"))
    out = s.join(g, "repo", "left").na.fill(0, ["gap_files", "critical_gaps", "complex_gaps"])
    overall = F.when(F.col("total") > 0, F.col("covered") / F.col("total") * 100).otherwise(F.lit(0.0))
    return out.select("repo", "total_files", "covered", "total", overall.alias("overall_coverage"),
                      "tested_files", "untested_files", "gap_files", "critical_gaps", "complex_gaps")


def findings_coverage(summary: DataFrame, target: float = 80.0) -> DataFrame:
    """Critical gaps; overall below target; untested files; complex gaps."""
    rules = [Rule("critical_gaps", "critical_gaps", ">", 0),
             Rule("below_target", "overall_coverage", "<", target),
             Rule("untested_files", "untested_files", ">", 0),
             Rule("complex_gaps", "complex_gaps", ">", 0)]
    return findings(summary, "coverage", rules)
