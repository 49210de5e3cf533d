"""Framework and pattern queries over the document corpus.

Binding: words of the documents play the import names; a binding
dictionary maps prose prefixes to framework keys, and line detectors use
prose tokens, so every branch (gating, precedence, summaries) is exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frameworks as FW
from ..operators import patterns as P
from ..sources import corpus
from . import sql_common as S
from .registry import register
from .tables import doc_files, doc_words

# The binding dictionary (framework key -> prose prefixes).
BINDING_PREFIXES = {
    "pandas": ["the"],
    "numpy": ["Ni"],
    "sklearn": ["Zu"],
    "matplotlib": ["Sch"],
    "seaborn": ["Qu"],
    "fastapi": ["Tz"],
    "django": ["Vi"],
    "flask": ["Pf"],
    "jupyter": ["Ha"],
    "tensorflow": ["tion"],
    "pytorch": ["ment"],
    "streamlit": ["st"],
}

# Binding line detectors (prose tokens and guards).
DF_DET = P.LineDetector("dataframe", ["the", "der", "les", "los", "and", "und", "des"],
                        [". ", ", "], ["pandas"])
ARR_DET = P.LineDetector("array", ["tion", "ment", "heit", "ung", "ier", "eau", "ch"],
                         ["e.", "n."], ["numpy"])
VIZ_DET = P.LineDetector("visualization", ["on", "en", "an", "er", "in", "at", "ou"],
                         ["th", "qu"], ["matplotlib", "seaborn"])
PIPE_TOKEN = "The"
MODEL_TOKENS = ["Qu", "Sch", "Ha"]
REQUIRES = {"dataframe": ["pandas"], "array": ["numpy"], "visualization": ["matplotlib", "seaborn"],
            "pipeline": ["sklearn"], "model": ["sklearn"]}


def _lines(spark, d):
    return corpus.line_table(doc_files(spark, d))


def file_frameworks(spark, d):
    imports = doc_words(spark, d).select("repo", "path", F.col("name").alias("module"))
    return FW.match_prefix_dict(imports, BINDING_PREFIXES)


def repo_fw(spark, d):
    return FW.all_repos_frameworks(doc_files(spark, d), FW.repo_frameworks(file_frameworks(spark, d)))


def raw_hits(spark, d):
    return P.detect_lines(_lines(spark, d), [DF_DET, ARR_DET, VIZ_DET], PIPE_TOKEN, MODEL_TOKENS)


def gated_hits(spark, d):
    return P.gate_by_framework(raw_hits(spark, d), repo_fw(spark, d), REQUIRES)


def _values(pairs):
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


SQL_FW = S.DOC_WORDS + r""",
fw_dict(framework, token) AS (VALUES """ + _values(
    [(k, t) for k, ts in BINDING_PREFIXES.items() for t in ts]) + r"""),
file_fw AS (
  SELECT DISTINCT w.repo, w.path, d.framework
  FROM doc_words w JOIN fw_dict d ON starts_with(w.name, d.token)
),
repo_fw AS (
  SELECT r.repo, coalesce(list_sort(f.fws), []) AS frameworks FROM (SELECT DISTINCT repo FROM doc_files) r
  LEFT JOIN (SELECT repo, list(DISTINCT framework) AS fws FROM file_fw GROUP BY repo) f ON r.repo = f.repo
)"""


def _first_token_sql(det, typ):
    cases = " ".join(f"WHEN contains(line, '{t}') THEN '{t}'" for t in det.tokens)
    guard = " OR ".join(f"contains(line, '{g}')" for g in det.guards)
    return (f"SELECT repo, path, line_no AS line, '{typ}' AS type, CASE {cases} END AS operation "
            f"FROM doc_lines WHERE ({guard}) AND CASE {cases} END IS NOT NULL")


SQL_HITS = r""",
raw_hits AS (
  """ + _first_token_sql(DF_DET, "dataframe") + """
  UNION ALL """ + _first_token_sql(ARR_DET, "array") + """
  UNION ALL """ + _first_token_sql(VIZ_DET, "visualization") + r"""
  UNION ALL
  SELECT repo, path, line_no AS line,
         CASE WHEN contains(line, 'The') THEN 'pipeline' ELSE 'model' END AS type, CAST(NULL AS VARCHAR) AS operation
  FROM doc_lines WHERE contains(line, 'The') OR contains(line, 'Qu') OR contains(line, 'Sch') OR contains(line, 'Ha')
),
gated AS (
  SELECT h.* FROM raw_hits h JOIN repo_fw r ON h.repo = r.repo
  WHERE (h.type = 'dataframe' AND list_contains(r.frameworks, 'pandas'))
     OR (h.type = 'array' AND list_contains(r.frameworks, 'numpy'))
     OR (h.type = 'visualization' AND (list_contains(r.frameworks, 'matplotlib') OR list_contains(r.frameworks, 'seaborn')))
     OR (h.type IN ('pipeline', 'model') AND list_contains(r.frameworks, 'sklearn'))
),
summary AS (
  SELECT repo, CASE WHEN grouping(type) = 1 THEN 'total' ELSE type END AS type, count(*) AS n
  FROM gated GROUP BY GROUPING SETS ((repo, type), (repo))
)"""

SQL_PATTERNS = SQL_FW + SQL_HITS

PROJECT_TYPE_SQL = """CASE
  WHEN list_contains(frameworks, 'fastapi') THEN 'fastapi'
  WHEN list_contains(frameworks, 'django') THEN 'django'
  WHEN list_contains(frameworks, 'flask') THEN 'flask'
  WHEN list_contains(frameworks, 'pandas') OR list_contains(frameworks, 'numpy') THEN 'data-analysis'
  WHEN list_contains(frameworks, 'tensorflow') OR list_contains(frameworks, 'pytorch') THEN 'machine-learning'
  WHEN list_contains(frameworks, 'jupyter') THEN 'jupyter'
  ELSE 'python' END"""


@register("prefix_dict", "WITH " + SQL_FW + "\nSELECT repo, path, framework FROM file_fw")
def q_prefix_dict(spark, d):
    return file_frameworks(spark, d)


@register("repo_frameworks", "WITH " + SQL_FW + r"""
SELECT repo, array_to_string(frameworks, ',') AS frameworks, CAST(len(frameworks) AS INTEGER) AS n_frameworks FROM repo_fw""")
def q_repo_frameworks(spark, d):
    r = repo_fw(spark, d)
    return r.select("repo", F.array_join("frameworks", ",").alias("frameworks"),
                    F.size("frameworks").alias("n_frameworks"))


@register("classify_by_precedence", "WITH " + SQL_FW + f"""
SELECT repo, {PROJECT_TYPE_SQL} AS project_type FROM repo_fw""")
def q_classify(spark, d):
    return FW.classify_by_precedence(repo_fw(spark, d))


@register("first_token_match", "WITH " + SQL_PATTERNS + """
SELECT * FROM raw_hits WHERE type IN ('dataframe', 'array', 'visualization')""")
def q_first_token_match(spark, d):
    lines = _lines(spark, d)
    return (P.first_token_match(lines, DF_DET).unionByName(P.first_token_match(lines, ARR_DET))
            .unionByName(P.first_token_match(lines, VIZ_DET)))


@register("ml_usage_lines", "WITH " + SQL_PATTERNS + """
SELECT * FROM raw_hits WHERE type IN ('pipeline', 'model')""")
def q_ml_usage_lines(spark, d):
    return P.ml_usage_lines(_lines(spark, d), PIPE_TOKEN, MODEL_TOKENS)


@register("gate_by_framework", "WITH " + SQL_PATTERNS + "\nSELECT * FROM gated")
def q_gate(spark, d):
    return gated_hits(spark, d)


@register("pattern_summary", "WITH " + SQL_PATTERNS + "\nSELECT * FROM summary")
def q_summary(spark, d):
    return P.pattern_summary(gated_hits(spark, d))


@register("pattern_type_filter", "WITH " + SQL_PATTERNS + """
SELECT repo, type, count(*) AS n FROM gated WHERE type IN ('visualization', 'model') GROUP BY repo, type""")
def q_type_filter(spark, d):
    kept = P.type_filter(gated_hits(spark, d), ["viz", "model"])
    return kept.groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"))


@register("antipatterns", "WITH " + SQL_PATTERNS + """
SELECT repo, 'excessive-dataframe-operations' AS antipattern, 'warning' AS severity, n AS count
FROM summary WHERE type = 'dataframe' AND n > 50""")
def q_antipatterns(spark, d):
    return P.antipatterns(P.pattern_summary(gated_hits(spark, d)))


@register("best_practices", "WITH " + SQL_PATTERNS + r""",
cnt AS (
  SELECT repo, sum(CASE WHEN type = 'dataframe' THEN n ELSE 0 END) AS n_df,
         sum(CASE WHEN type = 'pipeline' THEN n ELSE 0 END) AS n_pipe FROM summary GROUP BY repo
),
j AS (SELECT r.repo, r.frameworks, coalesce(c.n_df, 0) AS n_df, coalesce(c.n_pipe, 0) AS n_pipe
      FROM repo_fw r LEFT JOIN cnt c ON r.repo = c.repo)
SELECT repo, 'DataFrame Operations' AS practice, CASE WHEN n_df > 0 THEN 'follows' ELSE 'not-detected' END AS status
FROM j WHERE list_contains(frameworks, 'pandas')
UNION ALL
SELECT repo, 'ML Pipelines', CASE WHEN n_pipe > 0 THEN 'follows' ELSE 'missing' END
FROM j WHERE list_contains(frameworks, 'sklearn')""")
def q_best_practices(spark, d):
    return P.best_practices(repo_fw(spark, d), P.pattern_summary(gated_hits(spark, d)))


@register("findings_patterns", "WITH " + SQL_PATTERNS + r""",
cnt AS (
  SELECT repo, sum(CASE WHEN type = 'dataframe' THEN n ELSE 0 END) AS n_df,
         sum(CASE WHEN type = 'async' THEN n ELSE 0 END) AS n_async FROM summary GROUP BY repo
),
anti_rows AS (SELECT repo, count(*) AS n_antipatterns FROM summary WHERE type = 'dataframe' AND n > 50 GROUP BY repo),
j AS (SELECT r.repo, list_contains(r.frameworks, 'pandas') AS has_pandas,
             coalesce(c.n_df, 0) AS n_df, coalesce(c.n_async, 0) AS n_async,
             coalesce(a.n_antipatterns, 0) AS n_antipatterns
      FROM repo_fw r LEFT JOIN cnt c ON r.repo = c.repo LEFT JOIN anti_rows a ON r.repo = a.repo),
fired AS (
  SELECT repo, 0 AS rule_ord, 'antipatterns_found' AS rule, CAST(n_antipatterns AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold FROM j WHERE n_antipatterns > 0
  UNION ALL SELECT repo, 1, 'pandas_without_dataframe_ops', n_df, CAST(0 AS DOUBLE) FROM j WHERE n_df = 0 AND has_pandas
  UNION ALL SELECT repo, 2, 'good_async_use', n_async, CAST(10 AS DOUBLE) FROM j WHERE n_async > 10
)
SELECT repo, 'patterns' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL
SELECT repo, 'patterns', 3, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j WHERE repo NOT IN (SELECT repo FROM fired)""")
def q_findings_patterns(spark, d):
    return P.findings_patterns(repo_fw(spark, d), P.pattern_summary(gated_hits(spark, d)))


SQL_SYNTAX = r"""
ev AS (
  SELECT e.event_id, e.user_id, e.event_type, e.value, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
         c.c_nationkey
  FROM events e JOIN customer c ON e.user_id = c.c_custkey
),
syn AS (
  SELECT 'nation' || CAST(c_nationkey AS VARCHAR) AS repo, 'u/' || CAST(user_id AS VARCHAR) || '.py' AS path,
         CAST(event_id AS INTEGER) AS line, 'f' || CAST(event_id AS VARCHAR) AS function,
         CASE WHEN event_type = 'view' THEN 'async_def' WHEN event_type IN ('click', 'signup') THEN 'decorator'
              WHEN event_type IN ('purchase', 'error') THEN 'with_item' END AS kind,
         event_type = 'signup' AS is_async,
         CASE WHEN value < 10 THEN 'call' WHEN value < 25 THEN 'name' ELSE 'attribute' END AS shape,
         event_id, k, CASE WHEN event_type = 'error' THEN 'lock' ELSE 'open' END AS manager
  FROM ev
),
syn2 AS (
  SELECT *,
    CASE WHEN shape = 'call' THEN '' WHEN shape = 'name' THEN (CASE WHEN k < 20 THEN 'get' ELSE 'cache' END)
         ELSE (CASE WHEN k < 50 THEN 'app.route' ELSE 'router.post' END) END AS deco_name,
    CASE WHEN shape = 'call' THEN '' WHEN shape = 'name' THEN (CASE WHEN k < 20 THEN 'get' ELSE 'cache' END)
         ELSE (CASE WHEN k < 50 THEN 'route' ELSE 'post' END) END AS deco_last
  FROM syn
),
nfw AS (SELECT 'nation' || CAST(n_nationkey AS VARCHAR) AS repo, n_regionkey <= 1 AS has_flask FROM nation)"""


@register("syntax_patterns", "WITH " + SQL_SYNTAX + r"""
SELECT s.repo, s.path, s.line, 'api' AS type, upper(s.deco_last) AS operation, s.function AS name
FROM syn2 s JOIN nfw n ON s.repo = n.repo
WHERE s.kind = 'decorator' AND NOT s.is_async AND s.shape IN ('name', 'attribute')
  AND s.deco_last IN ('get', 'post', 'put', 'delete', 'patch') AND n.has_flask
UNION ALL
SELECT repo, path, line, 'async', CAST(NULL AS VARCHAR), 'h' || CAST(event_id AS VARCHAR) FROM syn2 WHERE kind = 'async_def'
UNION ALL
SELECT repo, path, line, 'decorator', function, deco_name FROM syn2
WHERE kind = 'decorator' AND NOT is_async AND shape IN ('name', 'attribute') AND deco_name <> ''
  AND NOT starts_with(deco_name, 'app.')
UNION ALL
SELECT repo, path, line, 'context_manager', CAST(NULL AS VARCHAR), manager FROM syn2 WHERE kind = 'with_item' AND k >= 10""")
def q_syntax_patterns(spark, d):
    from .tables import event_syntax, nation_frameworks
    return P.syntax_patterns(event_syntax(spark, d), nation_frameworks(spark, d))


SQL_FW_DEFAULT = S.DOC_WORDS + r""",
fw_dict(framework, token) AS (VALUES """ + _values(
    [(k, t) for k, ts in FW.FRAMEWORK_PREFIXES.items() for t in ts]) + r"""),
file_fw AS (
  SELECT DISTINCT w.repo, w.path, d.framework
  FROM doc_words w JOIN fw_dict d ON starts_with(w.name, d.token)
),
repo_fw AS (
  SELECT r.repo, coalesce(list_sort(f.fws), []) AS frameworks FROM (SELECT DISTINCT repo FROM doc_files) r
  LEFT JOIN (SELECT repo, list(DISTINCT framework) AS fws FROM file_fw GROUP BY repo) f ON r.repo = f.repo
)"""


def _default_fw(spark, d):
    imports = doc_words(spark, d).select("repo", "path", F.col("name").alias("module"))
    ff = FW.match_prefix_dict(imports)  # the fixed 14-framework dictionary
    return ff, FW.all_repos_frameworks(doc_files(spark, d), FW.repo_frameworks(ff))


@register("prefix_dict_default", "WITH " + SQL_FW_DEFAULT + "\nSELECT repo, path, framework FROM file_fw")
def q_prefix_dict_default(spark, d):
    return _default_fw(spark, d)[0]


@register("classify_default", "WITH " + SQL_FW_DEFAULT + f"""
SELECT repo, array_to_string(frameworks, ',') AS frameworks, {PROJECT_TYPE_SQL} AS project_type FROM repo_fw""")
def q_classify_default(spark, d):
    rf = _default_fw(spark, d)[1]
    return (rf.join(FW.classify_by_precedence(rf), "repo")
            .select("repo", F.array_join("frameworks", ",").alias("frameworks"), "project_type"))
