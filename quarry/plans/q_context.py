"""Context queries. Binding: every user turn of a conversation is a task for
one of the document repos, chosen by a hash; the document corpus is the file
set; a prose keyword dictionary stands in for the code one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as CX
from ..session import cut_lineage
from ..sources import corpus
from . import sql_common as S
from .q_patterns import SQL_FW, repo_fw
from .registry import register
from .tables import conversation_tasks, doc_files

# Binding keyword dictionary (prose words, one with a space).
KEYWORDS = ["en", "fr", "de", "es", "src1", "the", "an", "on", "er", "ou", "ch", "ie",
            "eau", "tion", "ment", "aux", "ein", "que", "la vie"]
FOCUS = ["de/"]
STRATEGY = "depth"
MAX_TOKENS = 2000


def _analyzed(spark, d):
    """Task analysis, materialised once per query: it is one row per task
    and every later stage (scoring, summaries, findings) reads it."""
    return cut_lineage(CX.analyze_tasks(conversation_tasks(spark, d), repo_fw(spark, d), KEYWORDS))


def _scored(spark, d, analyzed=None):
    a = analyzed if analyzed is not None else _analyzed(spark, d)
    return CX.relevance(a, doc_files(spark, d), FOCUS, STRATEGY, KEYWORDS)


def _ranked(spark, d):
    return CX.rank_files(_analyzed(spark, d), doc_files(spark, d), FOCUS, STRATEGY, KEYWORDS)


def _modules(spark, d):
    return corpus.modules_from_files(doc_files(spark, d))


def _selected(spark, d, analyzed=None):
    a = analyzed if analyzed is not None else _analyzed(spark, d)
    return CX.select_within_budget(a, doc_files(spark, d), _modules(spark, d), MAX_TOKENS, FOCUS, STRATEGY, KEYWORDS)


def _kw_sql(keywords=None):
    return "[" + ", ".join(f"'{w}'" for w in (keywords or KEYWORDS)) + "]"


def _score_sql(keywords=None, focus=None, strategy=None):
    keywords, focus, strategy = keywords or KEYWORDS, focus or FOCUS, strategy or STRATEGY
    terms = ["CASE WHEN " + " OR ".join(f"contains(f.path, '{a}')" for a in focus) + " THEN 10 ELSE 0 END"]
    for w in keywords:
        terms.append(f"CASE WHEN list_contains(t.keywords, '{w}') AND (contains(lower(f.path), '{w.replace(' ', '_')}') "
                     f"OR contains(lower(f.path), '{w.replace(' ', '')}')) THEN 5 ELSE 0 END")
    for name, _, toks in CX.DOMAINS:
        cond = " OR ".join(f"contains(lower(f.path), '{x}')" for x in toks)
        terms.append(f"CASE WHEN list_contains(t.concepts, '{name}') AND ({cond}) THEN 3 ELSE 0 END")
    toks, inc = CX.STRATEGY[strategy]
    terms.append("CASE WHEN " + " OR ".join(f"contains(lower(f.path), '{x}')" for x in toks) + f" THEN {inc} ELSE 0 END")
    terms.append("CASE WHEN " + " OR ".join(f"contains(lower(f.path), '{x}')" for x in CX.CORE_TOKENS) + " THEN 1 ELSE 0 END")
    return "least(10, " + " + ".join(terms) + ")"


def _sql_ctx(keywords=None, focus=None, strategy=None, max_tokens=None):
    max_tokens = max_tokens or MAX_TOKENS
    return SQL_FW + ",\n" + S.DOC_MODULES.replace(S.DOC_FILES + ",", "") + r""",
conv_tasks AS (
  SELECT t.task_id, r.repo, t.text
  FROM (SELECT conv_id || ':' || turn AS task_id, text FROM conversations WHERE role = 'user') t
  LEFT JOIN (SELECT source AS repo, row_number() OVER (ORDER BY source) - 1 AS nth FROM documents WHERE source IS NOT NULL GROUP BY source) r
    ON r.nth = ('0x' || left(md5(t.task_id), 8))::BIGINT % (SELECT count(DISTINCT source) FROM documents)
),
analyzed AS (
  SELECT c.task_id, c.repo, c.text,
    CASE WHEN contains(lower(c.text), 'fix') OR contains(lower(c.text), 'bug') OR contains(lower(c.text), 'error') OR contains(lower(c.text), 'issue') THEN 'bugfix'
         WHEN contains(lower(c.text), 'refactor') OR contains(lower(c.text), 'improve') OR contains(lower(c.text), 'optimize') THEN 'refactoring'
         WHEN contains(lower(c.text), 'test') OR contains(lower(c.text), 'coverage') THEN 'testing'
         ELSE 'feature' END AS task_type,
    list_sort(list_distinct(list_filter(""" + _kw_sql(keywords) + r""", lambda w: contains(lower(c.text), w)))) AS keywords,
    list_filter([
      CASE WHEN list_contains(r.frameworks, 'pandas') OR list_contains(r.frameworks, 'numpy') THEN 'data-analysis' END,
      CASE WHEN list_contains(r.frameworks, 'sklearn') THEN 'machine-learning' END,
      CASE WHEN list_contains(r.frameworks, 'fastapi') OR list_contains(r.frameworks, 'django') OR list_contains(r.frameworks, 'flask') THEN 'web-api' END
    ], lambda x: x IS NOT NULL) AS concepts,
    coalesce(r.frameworks, []) AS frameworks
  FROM conv_tasks c LEFT JOIN repo_fw r ON c.repo = r.repo
),
scored AS (
  SELECT * FROM (
    SELECT t.task_id, t.repo, f.path, CAST(""" + _score_sql(keywords, focus, strategy) + r""" AS INTEGER) AS score10
    FROM analyzed t JOIN doc_files f ON t.repo = f.repo
  ) WHERE score10 > 0
),
ranked AS (
  SELECT s.*, s.score10 / 10 AS score, m.n_lines AS lines, CAST(m.n_lines AS BIGINT) * 4 AS est_tokens,
    CAST(row_number() OVER (PARTITION BY s.task_id ORDER BY s.score10 DESC, """ + S.pkey("s.path") + r""") AS BIGINT) AS rank,
    CAST(sum(CAST(m.n_lines AS BIGINT) * 4) OVER (PARTITION BY s.task_id ORDER BY s.score10 DESC, """ + S.pkey("s.path") + r"""
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_tokens
  FROM scored s JOIN doc_modules m ON s.repo = m.repo AND s.path = m.path
),
selected AS (SELECT * FROM ranked WHERE running_tokens <= """ + str(max_tokens) + r"""),
bsum AS (
  SELECT t.task_id, CAST(""" + str(max_tokens) + r""" AS BIGINT) AS max_tokens, CAST(coalesce(u.used, 0) AS BIGINT) AS used,
         CAST(""" + str(max_tokens) + r""" - coalesce(u.used, 0) AS BIGINT) AS remaining, coalesce(u.n_selected, 0) AS n_selected
  FROM conv_tasks t LEFT JOIN (SELECT task_id, sum(est_tokens) AS used, count(*) AS n_selected FROM selected GROUP BY task_id) u
    ON t.task_id = u.task_id
)"""


SQL_CTX = _sql_ctx()


@register("task_type", "WITH " + SQL_CTX + "\nSELECT task_id, repo, task_type FROM analyzed")
def q_task_type(spark, d):
    return _analyzed(spark, d).select("task_id", "repo", "task_type")


@register("task_keywords", "WITH " + SQL_CTX + r"""
SELECT task_id, array_to_string(keywords, ',') AS keywords, CAST(len(keywords) AS INTEGER) AS n_keywords FROM analyzed""")
def q_task_keywords(spark, d):
    a = _analyzed(spark, d)
    return a.select("task_id", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").alias("n_keywords"))


@register("domain_concepts", "WITH " + SQL_CTX + r"""
SELECT DISTINCT repo, array_to_string(concepts, ',') AS concepts FROM analyzed""")
def q_domain_concepts(spark, d):
    a = _analyzed(spark, d)
    return a.select("repo", F.array_join("concepts", ",").alias("concepts")).distinct()


@register("rank_relevant", "WITH " + SQL_CTX + "\nSELECT task_id, repo, path, score10, score, rank FROM ranked")
def q_rank_relevant(spark, d):
    return _ranked(spark, d).select("task_id", "repo", "path", "score10", "score", "rank")


@register("budget_cut", "WITH " + SQL_CTX + r"""
SELECT task_id, repo, path, score10, score, lines, est_tokens, running_tokens FROM selected""")
def q_budget_cut(spark, d):
    return _selected(spark, d).select("task_id", "repo", "path", "score10", "score", "lines",
                                      "est_tokens", "running_tokens")


@register("budget_summary", "WITH " + SQL_CTX + "\nSELECT * FROM bsum")
def q_budget_summary(spark, d):
    return CX.budget_summary(conversation_tasks(spark, d), _selected(spark, d), MAX_TOKENS)


@register("pack_files", "WITH " + SQL_CTX + r"""
SELECT s.task_id, s.repo, s.path, s.score AS relevance, s.lines, s.rank,
       CASE WHEN s.score10 >= 7 THEN f.content END AS content
FROM selected s
JOIN doc_files f ON s.repo = f.repo AND s.path = f.path
WHERE s.rank <= 20""")
def q_pack_files(spark, d):
    p = CX.pack_files(_selected(spark, d), doc_files(spark, d), 20, 0.7)
    return p.select("task_id", "repo", "path", F.col("score").alias("relevance"), "lines", "rank", "content")


@register("selected_layers", "WITH " + SQL_CTX + r"""
SELECT t.task_id, coalesce(array_to_string(l.layers, ','), '') AS layers
FROM conv_tasks t LEFT JOIN (
  SELECT task_id, list_sort(list(DISTINCT split_part(path, '/', 1))) AS layers FROM selected
  WHERE contains(path, '/') GROUP BY task_id) l ON t.task_id = l.task_id""")
def q_selected_layers(spark, d):
    s = CX.selected_layers(conversation_tasks(spark, d), _selected(spark, d))
    return s.select("task_id", F.array_join("layers", ",").alias("layers"))


@register("findings_context", "WITH " + SQL_CTX + r""",
j AS (
  SELECT a.task_id, a.frameworks, coalesce(b.n_selected, 0) AS n_selected, a.task_type,
         len(list_filter(a.keywords, lambda k: contains(k, 'dataframe'))) > 0 AS df_keyword
  FROM analyzed a LEFT JOIN bsum b ON a.task_id = b.task_id
),
fired AS (
  SELECT task_id, 0 AS rule_ord, 'feature_task' AS rule, CAST(1 AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS threshold FROM j WHERE task_type = 'feature'
  UNION ALL SELECT task_id, 1, 'bugfix_task', 1, 1 FROM j WHERE task_type = 'bugfix'
  UNION ALL SELECT task_id, 2, 'refactoring_task', 1, 1 FROM j WHERE task_type = 'refactoring'
  UNION ALL SELECT task_id, 3, 'vectorize_dataframes', 1, 1 FROM j WHERE df_keyword AND list_contains(frameworks, 'pandas')
  UNION ALL SELECT task_id, 4, 'use_pipelines', 1, 1 FROM j WHERE list_contains(frameworks, 'sklearn')
  UNION ALL SELECT task_id, 5, 'rest_practices', 1, 1 FROM j
    WHERE list_contains(frameworks, 'fastapi') OR list_contains(frameworks, 'django') OR list_contains(frameworks, 'flask')
  UNION ALL SELECT task_id, 6, 'limited_context', n_selected, 5 FROM j WHERE n_selected < 5
  UNION ALL SELECT task_id, 7, 'large_context', n_selected, 15 FROM j WHERE n_selected > 15
)
SELECT task_id, 'context' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL SELECT task_id, 'context', 8, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j
WHERE task_id NOT IN (SELECT task_id FROM fired)""")
def q_findings_context(spark, d):
    a = _analyzed(spark, d)
    summ = CX.budget_summary(conversation_tasks(spark, d), _selected(spark, d, a), MAX_TOKENS)
    return CX.findings_context(a, summ)


# Variant with the fixed keyword dictionary, the breadth strategy and a larger budget.
DEFAULT_FOCUS, DEFAULT_STRATEGY, DEFAULT_MAX = ["en/"], "breadth", 5000


@register("budget_cut_default", "WITH " + _sql_ctx(CX.DEFAULT_KEYWORDS, DEFAULT_FOCUS, DEFAULT_STRATEGY, DEFAULT_MAX) + r"""
SELECT task_id, repo, path, score10, score, lines, est_tokens, running_tokens FROM selected""")
def q_budget_cut_default(spark, d):
    a = cut_lineage(CX.analyze_tasks(conversation_tasks(spark, d), repo_fw(spark, d), CX.DEFAULT_KEYWORDS))
    sel = CX.select_within_budget(a, doc_files(spark, d), _modules(spark, d), DEFAULT_MAX, DEFAULT_FOCUS, DEFAULT_STRATEGY)
    return sel.select("task_id", "repo", "path", "score10", "score", "lines", "est_tokens", "running_tokens")
