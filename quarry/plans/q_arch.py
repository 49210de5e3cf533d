"""Architecture queries. Binding: orders are files, line items are blocks
(complexity = quantity), items of status F / O are functions / classes,
repo = order priority, path = status/<orderkey>.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as A
from . import sql_common as S
from .registry import register
from .tables import order_blocks, order_entities, order_modules, page_files

MIN_CX = 100
TOP_K = 10


def _metrics(spark, d, min_cx=MIN_CX):
    mods = order_modules(spark, d)
    return A.file_metrics(mods, order_blocks(spark, d), order_entities(spark, d, "F"),
                          order_entities(spark, d, "O"), min_complexity=min_cx)


def _detailed(spark, d):
    return A.top_files(_metrics(spark, d), TOP_K)


SQL_BASE = S.ORDER_ITEMS + r""",
fn AS (SELECT repo, path, count(*) AS n FROM order_items WHERE l_linestatus = 'F' GROUP BY repo, path),
cl AS (SELECT repo, path, count(*) AS n FROM order_items WHERE l_linestatus = 'O' GROUP BY repo, path),
bt AS (SELECT repo, path, CAST(sum(complexity) AS BIGINT) AS total_complexity, max(complexity) AS max_complexity,
              count(*) AS n_blocks FROM order_items GROUP BY repo, path),
totals AS (
  SELECT m.repo, m.path, coalesce(b.total_complexity, 0) AS total_complexity,
         coalesce(b.max_complexity, 0) AS max_complexity, coalesce(b.n_blocks, 0) AS n_blocks,
         CASE WHEN coalesce(b.n_blocks, 0) > 0 THEN b.total_complexity / b.n_blocks ELSE 0.0 END AS avg_complexity
  FROM order_modules m LEFT JOIN bt b ON m.repo = b.repo AND m.path = b.path
),
metrics AS (
  SELECT m.repo, m.path, m.n_lines AS lines, t.total_complexity AS complexity, 100.0::DOUBLE AS maintainability,
         coalesce(fn.n, 0) AS functions, coalesce(cl.n, 0) AS classes, CAST(0 AS BIGINT) AS imports
  FROM order_modules m JOIN totals t ON m.repo = t.repo AND m.path = t.path
  LEFT JOIN fn ON m.repo = fn.repo AND m.path = fn.path
  LEFT JOIN cl ON m.repo = cl.repo AND m.path = cl.path
  WHERE t.total_complexity >= """ + str(MIN_CX) + r"""
),
detailed AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, """ + S.pkey("path") + r""") AS INTEGER) AS rank
    FROM metrics) WHERE rank <= """ + str(TOP_K) + r"""
),
rmetrics AS (
  SELECT m.repo, m.total_files, m.total_lines, coalesce(t.tc, 0) AS total_complexity,
         coalesce(t.tc, 0) / m.total_files AS avg_complexity, m.total_lines / m.total_files AS avg_lines,
         coalesce(dd.mx, 0) AS max_detailed_complexity
  FROM (SELECT repo, count(*) AS total_files, CAST(sum(n_lines) AS BIGINT) AS total_lines FROM order_modules GROUP BY repo) m
  LEFT JOIN (SELECT repo, CAST(sum(total_complexity) AS BIGINT) AS tc FROM totals GROUP BY repo) t ON m.repo = t.repo
  LEFT JOIN (SELECT repo, max(complexity) AS mx FROM detailed GROUP BY repo) dd ON m.repo = dd.repo
)"""


@register("structure_counts", "WITH " + SQL_BASE + r"""
SELECT m.repo, m.n_modules, coalesce(c.n, 0) AS n_classes, coalesce(f.n, 0) AS n_functions, m.total_lines
FROM (SELECT repo, count(*) AS n_modules, CAST(sum(n_lines) AS BIGINT) AS total_lines FROM order_modules GROUP BY repo) m
LEFT JOIN (SELECT repo, count(*) AS n FROM order_items WHERE l_linestatus = 'O' GROUP BY repo) c ON m.repo = c.repo
LEFT JOIN (SELECT repo, count(*) AS n FROM order_items WHERE l_linestatus = 'F' GROUP BY repo) f ON m.repo = f.repo""")
def q_structure_counts(spark, d):
    return A.structure_counts(order_modules(spark, d), order_entities(spark, d, "O"),
                              order_entities(spark, d, "F"))


@register("file_totals", "WITH " + SQL_BASE + "\nSELECT * FROM totals")
def q_file_totals(spark, d):
    return A.file_totals(order_modules(spark, d), order_blocks(spark, d))


@register("file_metrics", "WITH " + SQL_BASE + "\nSELECT * FROM metrics")
def q_file_metrics(spark, d):
    return _metrics(spark, d)


@register("top_files", "WITH " + SQL_BASE + "\nSELECT * FROM detailed")
def q_top_files(spark, d):
    return _detailed(spark, d)


@register("repo_metrics", "WITH " + SQL_BASE + "\nSELECT * FROM rmetrics")
def q_repo_metrics(spark, d):
    mods = order_modules(spark, d)
    totals = A.file_totals(mods, order_blocks(spark, d))
    return A.repo_metrics(mods, totals, _detailed(spark, d))


@register("complexity_rank", "WITH " + SQL_BASE + r"""
SELECT repo, path, name, line, complexity,
  CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C'
       WHEN complexity <= 30 THEN 'D' ELSE 'F' END AS rank
FROM order_items""")
def q_complexity_rank(spark, d):
    b = order_blocks(spark, d)
    return b.select("repo", "path", "name", "line", "complexity", A.complexity_rank().alias("rank"))


@register("high_complexity", "WITH " + SQL_BASE + r"""
SELECT repo, path, name, 'function' AS kind, line, complexity FROM order_items WHERE complexity >= 45""")
def q_high_complexity(spark, d):
    return A.high_complexity(order_blocks(spark, d), 45)


@register("first_n_entities", "WITH " + S.ORDER_ITEMS + r""",
ent AS (
  SELECT repo, path, name, line, CASE WHEN l_linestatus = 'O' THEN 'class' ELSE 'function' END AS kind,
         [CAST(line AS BIGINT), l_partkey, l_suppkey] AS seq
  FROM order_items
)
SELECT repo, kind, path, name, line, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, kind ORDER BY """ + S.pkey("path") + r""", seq) AS INTEGER) AS rank
  FROM ent) WHERE rank <= 20""")
def q_first_n_entities(spark, d):
    out = None
    for status, kind in (("O", "class"), ("F", "function")):
        e = order_entities(spark, d, status)
        r = A.first_n_entities(e, 20) \
            .select("repo", F.lit(kind).alias("kind"), "path", "name", "line", "rank")
        out = r if out is None else out.unionByName(r)
    return out


@register("hot_files", "WITH " + SQL_BASE + r"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY rank) AS INTEGER) AS hot_rank
  FROM detailed WHERE complexity >= 20) WHERE hot_rank <= 10""")
def q_hot_files(spark, d):
    return A.hot_files(_detailed(spark, d), 20, 10)


@register("findings_arch", "WITH " + SQL_BASE + r""",
nl AS (SELECT o_orderpriority AS repo, count(DISTINCT o_orderstatus) AS n_layers FROM orders GROUP BY 1),
j AS (SELECT r.*, coalesce(nl.n_layers, 0) AS n_layers FROM rmetrics r LEFT JOIN nl ON r.repo = nl.repo),
fired AS (
  SELECT repo, 0 AS rule_ord, 'very_high_complexity' AS rule, CAST(max_detailed_complexity AS DOUBLE) AS value, CAST(50 AS DOUBLE) AS threshold FROM j WHERE max_detailed_complexity > 50
  UNION ALL SELECT repo, 1, 'high_average_complexity', avg_complexity, CAST(15 AS DOUBLE) FROM j WHERE avg_complexity > 15
  UNION ALL SELECT repo, 2, 'large_without_layers', total_files, CAST(100 AS DOUBLE) FROM j WHERE total_files > 100 AND n_layers = 0
)
SELECT repo, 'arch' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL SELECT repo, 'arch', 3, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j WHERE repo NOT IN (SELECT repo FROM fired)""")
def q_findings_arch(spark, d):
    mods = order_modules(spark, d)
    totals = A.file_totals(mods, order_blocks(spark, d))
    rm = A.repo_metrics(mods, totals, _detailed(spark, d))
    layers = A.layer_rollup(mods.select("repo", "path"), sample=10)
    return A.findings_arch(rm, layers)


@register("class_edges", r"""
WITH pages_l AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)/?([^?#]*)', 1) AS repo,
         regexp_extract(url, '^[a-z]+://([^/?#]+)/?([^?#]*)', 2) AS path,
         regexp_extract_all(html, 'href="([^"]*)"', 1) AS bases
  FROM pages
),
e AS (SELECT repo, path, path AS class, unnest(bases) AS base FROM pages_l)
SELECT repo, path, class, base FROM e WHERE base <> '' AND base <> 'object'""")
def q_class_edges(spark, d):
    p = page_files(spark, d)
    classes = p.select("repo", "path", F.col("path").alias("name"),
                       F.regexp_extract_all("content", F.lit(r'href="([^"]*)"'), F.lit(1)).alias("bases"))
    return A.class_edges(classes)


@register("top_files_all", "WITH " + SQL_BASE + r"""
SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, """ + S.pkey("path") + r""") AS INTEGER) AS rank
FROM metrics""")
def q_top_files_all(spark, d):
    return A.top_files(_metrics(spark, d), 0)
