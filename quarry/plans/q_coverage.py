"""Coverage queries. Binding: customers are files (repo = nation,
path = segment/name.py), their events are the report's lines (covered when
purchase or signup), their orders are blocks (complexity = line items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as CV
from . import sql_common as S
from .registry import register
from .tables import customer_blocks, customer_coverage, customer_files

POLICY = CV.GapPolicy(lines_threshold=40.0, core_tokens=["machinery"], important_tokens=["furniture"],
                      reason_core_tokens=["machin"], reason_api_tokens=["furnit", "build"])


def _assessed(spark, d):
    per_file = CV.coverage_per_file(customer_coverage(spark, d))
    joined = CV.join_coverage(customer_files(spark, d), per_file)
    return CV.assess_files(joined, customer_blocks(spark, d), POLICY)


def _gaps(spark, d, priority="all"):
    return CV.gap_filter(_assessed(spark, d), priority)


SQL_COV = S.CUSTOMER + r""",
per_file AS (
  SELECT repo, filename,
         count(*) FILTER (WHERE hits <> 0) AS lines_covered, count(line_no) AS lines_total,
         CASE WHEN count(line_no) > 0 THEN count(*) FILTER (WHERE hits <> 0) / count(line_no) ELSE 0.0 END AS line_rate,
         list_sort(list(line_no) FILTER (WHERE hits = 0)) AS uncovered_lines
  FROM cov_rows GROUP BY repo, filename
),
joined AS (
  SELECT f.repo, f.path, coalesce(p.lines_covered, 0) AS lines_covered, coalesce(p.lines_total, 0) AS lines_total,
         coalesce(p.line_rate, 0.0) AS line_rate, coalesce(p.uncovered_lines, []) AS uncovered_lines
  FROM cfiles f LEFT JOIN per_file p ON f.repo = p.repo AND f.path = p.filename
),
cx AS (SELECT repo, path, CAST(sum(complexity) AS BIGINT) AS complexity FROM cblocks GROUP BY repo, path),
assessed AS (
  SELECT j.*, coalesce(cx.complexity, 0) AS complexity FROM joined j LEFT JOIN cx ON j.repo = cx.repo AND j.path = cx.path
),
assessed2 AS (
  SELECT *,
    CASE WHEN contains(lower(path), 'machinery') AND line_rate = 0 AND complexity > 30 THEN 'critical'
         WHEN contains(lower(path), 'machinery') AND line_rate < CAST(0.4 AS DOUBLE) THEN 'critical'
         WHEN contains(lower(path), 'furniture') AND line_rate < 0.5 THEN 'high'
         WHEN complexity > 50 AND line_rate < 0.5 THEN 'high'
         WHEN line_rate < CAST(0.4 AS DOUBLE) THEN 'medium'
         ELSE 'low' END AS priority,
    concat_ws(',',
      CASE WHEN line_rate = 0 THEN 'no_coverage' WHEN line_rate < CAST(0.4 AS DOUBLE) THEN 'below_threshold' END,
      CASE WHEN complexity > 50 THEN 'very_high_complexity' WHEN complexity > 30 THEN 'high_complexity' END,
      CASE WHEN contains(lower(path), 'machin') THEN 'core_utility'
           WHEN contains(lower(path), 'furnit') OR contains(lower(path), 'build') THEN 'api_layer' END
    ) AS reasons,
    (line_rate < CAST(0.4 AS DOUBLE) OR line_rate = 0) AS is_gap
  FROM assessed
),
gaps AS (SELECT * FROM assessed2 WHERE is_gap),
ranked AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY
      CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END,
      complexity DESC, """ + S.pkey("path") + r""") AS INTEGER) AS rank
    FROM gaps) WHERE rank <= 50
),
csum AS (
  SELECT s.repo, s.total_files, s.covered, s.total,
         CASE WHEN s.total > 0 THEN s.covered / s.total * 100 ELSE 0.0 END AS overall_coverage,
         s.tested_files, s.untested_files,
         coalesce(g.gap_files, 0) AS gap_files, coalesce(g.critical_gaps, 0) AS critical_gaps,
         coalesce(g.complex_gaps, 0) AS complex_gaps
  FROM (SELECT repo, CAST(sum(lines_covered) AS BIGINT) AS covered, CAST(sum(lines_total) AS BIGINT) AS total,
               count(*) FILTER (WHERE line_rate > 0) AS tested_files,
               count(*) FILTER (WHERE NOT (line_rate > 0)) AS untested_files, count(*) AS total_files
        FROM assessed2 GROUP BY repo) s
  LEFT JOIN (SELECT repo, count(*) AS gap_files, count(*) FILTER (WHERE priority = 'critical') AS critical_gaps,
                    count(*) FILTER (WHERE complexity > 50) AS complex_gaps FROM gaps GROUP BY repo) g
    ON s.repo = g.repo
)"""


@register("coverage_per_file", "WITH " + SQL_COV + r"""
SELECT repo, filename, lines_covered, lines_total, line_rate,
       array_to_string(uncovered_lines, ',') AS uncovered_lines FROM per_file""")
def q_coverage_per_file(spark, d):
    p = CV.coverage_per_file(customer_coverage(spark, d))
    return p.withColumn("uncovered_lines", F.array_join("uncovered_lines", ","))


@register("join_coverage", "WITH " + SQL_COV + r"""
SELECT repo, path, lines_covered, lines_total, line_rate, array_to_string(uncovered_lines, ',') AS uncovered_lines
FROM joined""")
def q_join_coverage(spark, d):
    per_file = CV.coverage_per_file(customer_coverage(spark, d))
    j = CV.join_coverage(customer_files(spark, d), per_file)
    return j.withColumn("uncovered_lines", F.array_join("uncovered_lines", ","))


@register("gap_priority", "WITH " + SQL_COV + r"""
SELECT repo, path, line_rate, complexity, priority, reasons, is_gap FROM assessed2""")
def q_gap_priority(spark, d):
    a = _assessed(spark, d)
    return a.select("repo", "path", "line_rate", "complexity", "priority",
                    F.array_join("reasons", ",").alias("reasons"), "is_gap")


@register("coverage_gaps", "WITH " + SQL_COV + r"""
SELECT repo, path, priority, reasons, complexity, line_rate, lines_covered, lines_total FROM gaps""")
def q_coverage_gaps(spark, d):
    g = _gaps(spark, d)
    return g.select("repo", "path", "priority", F.array_join("reasons", ",").alias("reasons"),
                    "complexity", "line_rate", "lines_covered", "lines_total")


@register("gap_functions", "WITH " + SQL_COV + r"""
SELECT g.repo, g.path, CAST(count(b.name) AS INTEGER) AS n_functions,
       coalesce(string_agg(b.name || ':' || CAST(b.complexity AS VARCHAR) || ':' || CAST(b.line AS VARCHAR), ','
                ORDER BY b.line, b.name, b.complexity), '') AS functions
FROM gaps g LEFT JOIN cblocks b ON g.repo = b.repo AND g.path = b.path
GROUP BY g.repo, g.path""")
def q_gap_functions(spark, d):
    g = CV.gap_functions(_gaps(spark, d), customer_blocks(spark, d))
    return g.select("repo", "path", F.size("functions").alias("n_functions"),
                    F.array_join(F.transform("functions", lambda s: F.concat_ws(
                        ":", s["name"], s["complexity"].cast("string"), s["line"].cast("string"))), ",")
                    .alias("functions"))


@register("gap_rank", "WITH " + SQL_COV + r"""
SELECT repo, path, priority, complexity, rank, (priority = 'critical' AND rank <= 10) AS in_critical_list FROM ranked""")
def q_gap_rank(spark, d):
    r = CV.gap_rank(_gaps(spark, d), 50, 10)
    return r.select("repo", "path", "priority", "complexity", "rank", "in_critical_list")


@register("gap_rank_critical", "WITH " + SQL_COV + r"""
SELECT repo, path, complexity, CAST(row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, """ + S.pkey("path") + r""") AS INTEGER) AS rank
FROM gaps WHERE priority = 'critical'
QUALIFY rank <= 50""")
def q_gap_rank_critical(spark, d):
    r = CV.gap_rank(_gaps(spark, d, "critical"), 50, 10)
    return r.select("repo", "path", "complexity", "rank")


@register("coverage_summary", "WITH " + SQL_COV + "\nSELECT * FROM csum")
def q_coverage_summary(spark, d):
    a = _assessed(spark, d)
    return CV.coverage_summary(a, CV.gap_filter(a))


@register("findings_coverage", "WITH " + SQL_COV + r""",
fired AS (
  SELECT repo, 0 AS rule_ord, 'critical_gaps' AS rule, CAST(critical_gaps AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold FROM csum WHERE critical_gaps > 0
  UNION ALL SELECT repo, 1, 'below_target', overall_coverage, CAST(40 AS DOUBLE) FROM csum WHERE overall_coverage < 40
  UNION ALL SELECT repo, 2, 'untested_files', untested_files, CAST(0 AS DOUBLE) FROM csum WHERE untested_files > 0
  UNION ALL SELECT repo, 3, 'complex_gaps', complex_gaps, CAST(0 AS DOUBLE) FROM csum WHERE complex_gaps > 0
)
SELECT repo, 'coverage' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL SELECT repo, 'coverage', 4, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM csum WHERE repo NOT IN (SELECT repo FROM fired)""")
def q_findings_coverage(spark, d):
    a = _assessed(spark, d)
    return CV.findings_coverage(CV.coverage_summary(a, CV.gap_filter(a)), target=40.0)
