"""Convention queries over the document corpus and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conventions as C
from ..session import cut_lineage
from ..sources import corpus
from . import sql_common as S
from .registry import register
from .tables import conversation_imports, doc_files, doc_modules, doc_words, role_imports

OUT = ["repo", "path", "line", "category", "severity", "rule", "actual"]


def _doc_lines(spark, d):
    return corpus.line_table(doc_files(spark, d))


def doc_violations(spark, d):
    """Words as names (lower-case initial: functions; upper-case initial:
    classes and constants), lines for style, labels for docstrings."""
    upper_initial = F.col("name").rlike(r"^\p{Lu}")
    naming = C.name_rules(doc_words(spark, d), function_if=~upper_initial,
                          class_if=upper_initial, constant_if=upper_initial)
    return C.violations(
        naming,
        C.rule_line_length(_doc_lines(spark, d)),
        C.rule_docstrings(doc_modules(spark, d)),
    )


SQL_DOC_VIOLATIONS = S.DOC_WORDS + ",\n" + S.DOC_MODULES.replace(S.DOC_FILES + ",", "") + r""",
v_all AS (
  SELECT repo, path, CAST(line AS INTEGER) AS line, 'naming' AS category, 'warning' AS severity,
         'Function naming' AS rule, name AS actual, 0 AS cat_ord, 0 AS rule_ord
  FROM doc_words
  WHERE NOT regexp_matches(name, '^\p{Lu}') AND NOT regexp_full_match(name, '[a-z_][a-z0-9_]*')
        AND NOT starts_with(name, '_')
  UNION ALL
  SELECT repo, path, CAST(line AS INTEGER), 'naming', 'warning', 'Class naming', name, 0, 1
  FROM doc_words
  WHERE regexp_matches(name, '^\p{Lu}') AND NOT regexp_full_match(name, '[A-Z][a-zA-Z0-9]*')
  UNION ALL
  SELECT repo, path, CAST(NULL AS INTEGER), 'naming', 'info', 'Constant naming', name, 0, 2
  FROM doc_words
  WHERE regexp_matches(name, '^\p{Lu}') AND NOT (upper(name) = name AND lower(name) <> name)
  UNION ALL
  SELECT repo, path, line_no, 'style', 'info', 'Line length', CAST(length(line) AS VARCHAR) || ' chars', 2, 0
  FROM doc_lines
  WHERE length(line) > 100 AND NOT starts_with(""" + S.lstrip("line") + r""", '#')
  UNION ALL
  SELECT repo, path, 1, 'docstrings', 'info', 'Module docstring', CAST(NULL AS VARCHAR), 3, 0
  FROM doc_modules WHERE coalesce(docstring, '') = ''
)"""


@register("rule_line_length", "WITH " + S.DOC_LINES + r"""
SELECT repo, path, line_no AS line, 'style' AS category, 'info' AS severity, 'Line length' AS rule,
       CAST(length(line) AS VARCHAR) || ' chars' AS actual
FROM doc_lines
WHERE length(line) > 100 AND NOT starts_with(""" + S.lstrip("line") + r""", '#')""")
def q_rule_line_length(spark, d):
    return C.rule_line_length(_doc_lines(spark, d)).select(*OUT)


@register("rule_names", "WITH " + SQL_DOC_VIOLATIONS + r"""
SELECT repo, rule, severity, count(*) AS n
FROM v_all WHERE category = 'naming' GROUP BY repo, rule, severity""")
def q_rule_names(spark, d):
    v = doc_violations(spark, d).where(F.col("category") == "naming")
    return v.groupBy("repo", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("rule_docstrings", "WITH " + S.DOC_MODULES + r"""
SELECT repo, path, 1 AS line, 'docstrings' AS category, 'info' AS severity,
       'Module docstring' AS rule, CAST(NULL AS VARCHAR) AS actual
FROM doc_modules WHERE coalesce(docstring, '') = ''""")
def q_rule_docstrings(spark, d):
    return C.rule_docstrings(doc_modules(spark, d)).select(*OUT)


SQL_CONV_IMPORTS = r"""
conv_imports AS (
  SELECT 'chat' AS repo, 'conv/' || CAST(conv_id AS VARCHAR) || '.py' AS path,
         CAST(turn AS INTEGER) AS line, role FROM conversations
)"""


@register("rule_import_grouping", "WITH " + SQL_CONV_IMPORTS + r"""
SELECT repo, path, min(line) AS line, 'imports' AS category, 'info' AS severity,
       'Import grouping' AS rule, CAST(count(*) AS VARCHAR) AS actual
FROM conv_imports GROUP BY repo, path
HAVING count(*) > 5 AND max(line) - min(line) = count(*) - 1 AND count(DISTINCT line) = count(*)""")
def q_rule_import_grouping(spark, d):
    return C.rule_import_grouping(conversation_imports(spark, d)).select(*OUT)


@register("rule_import_grouping_user", r"""
SELECT role AS repo, 'conv/' || CAST(conv_id AS VARCHAR) || '.py' AS path, CAST(1 AS INTEGER) AS line, 'imports' AS category,
       'info' AS severity, 'Import grouping' AS rule, CAST(count(*) AS VARCHAR) AS actual
FROM conversations GROUP BY role, conv_id HAVING count(*) > 2""")
def q_rule_import_grouping_user(spark, d):
    return C.rule_import_grouping(role_imports(spark, d), min_imports=2).select(*OUT)


def _counts(spark, d, minimum="warning"):
    return C.violation_counts(doc_violations(spark, d), doc_files(spark, d), minimum)


SQL_COUNTS = SQL_DOC_VIOLATIONS + r""",
by_cat AS (
  SELECT repo,
    count(*) FILTER (WHERE category = 'naming') AS naming,
    count(*) FILTER (WHERE category = 'imports') AS imports,
    count(*) FILTER (WHERE category = 'style') AS style,
    count(*) FILTER (WHERE category = 'docstrings') AS docstrings,
    count(*) FILTER (WHERE category = 'type_hints') AS type_hints
  FROM v_all GROUP BY repo
),
by_sev AS (
  SELECT repo, count(*) AS total_violations,
    count(*) FILTER (WHERE severity = 'error') AS error,
    count(*) FILTER (WHERE severity = 'warning') AS warning,
    count(*) FILTER (WHERE severity = 'info') AS info
  FROM v_all WHERE severity IN ('error', 'warning') GROUP BY repo
),
nf AS (SELECT repo, count(*) AS n_files FROM doc_files GROUP BY repo),
counts AS (
  SELECT nf.repo, nf.n_files,
    coalesce(c.naming, 0) AS naming, coalesce(c.imports, 0) AS imports, coalesce(c.style, 0) AS style,
    coalesce(c.docstrings, 0) AS docstrings, coalesce(c.type_hints, 0) AS type_hints,
    coalesce(s.total_violations, 0) AS total_violations, coalesce(s.error, 0) AS error,
    coalesce(s.warning, 0) AS warning, coalesce(s.info, 0) AS info,
    coalesce(c.naming, 0) + coalesce(c.imports, 0) + coalesce(c.style, 0)
      + coalesce(c.docstrings, 0) + coalesce(c.type_hints, 0) AS category_total
  FROM nf LEFT JOIN by_cat c ON nf.repo = c.repo LEFT JOIN by_sev s ON nf.repo = s.repo
),
scores AS (
  SELECT repo, n_files, category_total, total_violations,
    CAST(greatest(0, 100 - CAST(trunc(category_total / greatest(1, category_total + n_files) * 100) AS INTEGER)) AS INTEGER) AS overall,
    CAST(100 - CAST(trunc(naming / greatest(1, n_files) * 100) AS INTEGER) AS INTEGER) AS naming_score,
    CAST(100 - CAST(trunc(imports / greatest(1, n_files) * 100) AS INTEGER) AS INTEGER) AS imports_score,
    CAST(100 - CAST(trunc(style / greatest(1, n_files) * 100) AS INTEGER) AS INTEGER) AS style_score,
    CAST(100 - CAST(trunc(docstrings / greatest(1, n_files) * 100) AS INTEGER) AS INTEGER) AS docstrings_score,
    CAST(100 - CAST(trunc(type_hints / greatest(1, n_files) * 100) AS INTEGER) AS INTEGER) AS type_hints_score
  FROM counts
)"""


@register("violation_counts", "WITH " + SQL_COUNTS + "\nSELECT * FROM counts")
def q_violation_counts(spark, d):
    return _counts(spark, d)


@register("consistency", "WITH " + SQL_COUNTS + "\nSELECT * FROM scores")
def q_consistency(spark, d):
    return C.consistency(_counts(spark, d))


@register("severity_filter", "WITH " + SQL_DOC_VIOLATIONS + r"""
SELECT repo, path, line, category, severity, rule, actual, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY """ + S.pkey("path") + r""",
         cat_ord, rule_ord, line NULLS FIRST, actual) AS INTEGER) AS rank
  FROM v_all WHERE severity IN ('error', 'warning')
) WHERE rank <= 100""")
def q_severity_filter(spark, d):
    v = C.severity_filter(doc_violations(spark, d), "warning")
    return C.first_violations(v, 100).select(*OUT, "rank")


SQL_INFER = S.DOC_WORDS + r""",
sample AS (
  SELECT repo, path FROM (
    SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY """ + S.pkey("path") + r""") AS r
    FROM doc_files) WHERE r <= 20
),
sw AS (
  SELECT w.*, CASE WHEN regexp_matches(w.name, '^\p{Lu}') THEN 'class' ELSE 'function' END AS kind
  FROM doc_words w JOIN sample s ON w.repo = s.repo AND w.path = s.path
),
agg AS (
  SELECT repo, kind, count(*) AS occurrences,
    count(*) FILTER (WHERE (kind = 'function' AND regexp_full_match(name, '[a-z_][a-z0-9_]*'))
                        OR (kind = 'class' AND regexp_full_match(name, '[A-Z][a-zA-Z0-9]*'))) AS matching
  FROM sw GROUP BY repo, kind
),
ex AS (
  SELECT repo, kind, string_agg(name, ',' ORDER BY r) AS examples FROM (
    SELECT repo, kind, name, row_number() OVER (PARTITION BY repo, kind ORDER BY """ + S.pkey("path") + r""", seq) AS r
    FROM sw) WHERE r <= 3 GROUP BY repo, kind
)"""


@register("infer_convention", "WITH " + SQL_INFER + r"""
SELECT a.repo, 'naming' AS category,
       CASE WHEN a.kind = 'function' THEN 'Function naming' ELSE 'Class naming' END AS rule,
       CASE WHEN a.kind = 'function' THEN 'snake_case' ELSE 'PascalCase' END AS pattern,
       a.matching / a.occurrences AS confidence, a.occurrences, ex.examples
FROM agg a JOIN ex ON a.repo = ex.repo AND a.kind = ex.kind
WHERE a.occurrences > 0 AND a.matching / a.occurrences > (CASE WHEN a.kind = 'function' THEN 0.5 ELSE 0.8 END)""")
def q_infer_convention(spark, d):
    words = doc_words(spark, d)
    files = doc_files(spark, d)
    upper_initial = F.col("name").rlike(r"^\p{Lu}")
    fn = C.infer_convention(words.where(~upper_initial), files, "function", min_share=0.5)
    cl = C.infer_convention(words.where(upper_initial), files, "class", min_share=0.8)
    return fn.unionByName(cl)


@register("findings_conventions", "WITH " + SQL_COUNTS + r""",
j AS (SELECT s.repo, s.overall, c.naming, c.docstrings, c.style FROM scores s JOIN counts c ON s.repo = c.repo),
fired AS (
  SELECT repo, 0 AS rule_ord, 'low_consistency' AS rule, CAST(overall AS DOUBLE) AS value, CAST(70 AS DOUBLE) AS threshold FROM j WHERE overall < 70
  UNION ALL SELECT repo, 1, 'good_consistency', overall, CAST(90 AS DOUBLE) FROM j WHERE overall < 90 AND overall >= 70
  UNION ALL SELECT repo, 2, 'naming_inconsistencies', naming, CAST(10 AS DOUBLE) FROM j WHERE naming > 10
  UNION ALL SELECT repo, 3, 'missing_docstrings', docstrings, CAST(20 AS DOUBLE) FROM j WHERE docstrings > 20
  UNION ALL SELECT repo, 4, 'style_violations', style, CAST(15 AS DOUBLE) FROM j WHERE style > 15
  UNION ALL SELECT repo, 5, 'high_consistency', overall, CAST(90 AS DOUBLE) FROM j WHERE overall >= 90
)
SELECT repo, 'conventions' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL
SELECT repo, 'conventions', 5, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j
WHERE repo NOT IN (SELECT repo FROM fired)""")
def q_findings_conventions(spark, d):
    # one row a repo, written: scores and counts would each scan every word again
    counts = cut_lineage(_counts(spark, d))
    return C.findings_conventions(C.consistency(counts), counts)


@register("rule_return_hint", "WITH " + S.DOC_FILES + r"""
SELECT f.repo, f.path, 1 AS line, 'type_hints' AS category, 'info' AS severity,
       'Function return type' AS rule, regexp_extract(d.text, '^\p{L}+') AS actual
FROM doc_files f JOIN documents d ON f.doc_id = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL AND NOT starts_with(regexp_extract(d.text, '^\p{L}+'), '_')""")
def q_rule_return_hint(spark, d):
    from .tables import doc_functions
    return C.rule_return_hint(doc_functions(spark, d), required=True).select(*OUT)


@register("severity_filter_info", "WITH " + SQL_DOC_VIOLATIONS + r"""
SELECT repo, path, line, category, severity, rule, actual, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY """ + S.pkey("path") + r""",
         cat_ord, rule_ord, line NULLS FIRST, actual) AS INTEGER) AS rank
  FROM v_all
) WHERE rank <= 100""")
def q_severity_filter_info(spark, d):
    v = C.severity_filter(doc_violations(spark, d), "info")
    return C.first_violations(v, 100).select(*OUT, "rank")
