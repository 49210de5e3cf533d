"""Corpus queries: glob filtering, module keys, layers, line table.

Binding: ``pages`` as files (repo = host, path = URL path), ``documents``
for the line table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as A
from ..sources import corpus
from . import sql_common as S
from .registry import register
from .tables import doc_files, page_files

SQL_PAGES = r"""
page_files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)/?([^?#]*)', 1) AS repo,
         regexp_extract(url, '^[a-z]+://([^/?#]+)/?([^?#]*)', 2) AS path,
         html AS content, page_id
  FROM pages
)"""

INCLUDE = ["**/*.html", "es/*"]
EXCLUDE = ["**/1*", "de/**"]


def _selected_pages(spark, d):
    files = page_files(spark, d)
    return corpus.dedupe_sorted(corpus.glob_filter(files, INCLUDE, EXCLUDE))


@register("glob_filter", "WITH " + SQL_PAGES + r"""
SELECT DISTINCT repo, path FROM page_files
WHERE (path LIKE '%.html' OR (path LIKE 'es/%' AND path NOT LIKE 'es/%/%'))
  AND NOT (path LIKE '%/1%' OR path LIKE 'de/%')""")
def q_glob_filter(spark, d):
    return _selected_pages(spark, d).select("repo", "path")


@register("module_key", "WITH " + SQL_PAGES + r"""
SELECT DISTINCT repo, path,
  replace(regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', ''), '(^|/)__init__$', ''), '/', '.') AS module
FROM page_files""")
def q_module_key(spark, d):
    files = corpus.dedupe_sorted(page_files(spark, d).select("repo", "path", "content"))
    return corpus.with_module_key(files, ".html").select("repo", "path", "module")


@register("layer_rollup", "WITH " + SQL_PAGES + r""",
f AS (SELECT DISTINCT repo, path FROM page_files),
l AS (SELECT repo, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS layer FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, layer ORDER BY """ + S.pkey("path") + r""") AS r FROM l),
agg AS (
  SELECT repo, layer, count(*) AS module_count,
         string_agg(CASE WHEN r <= 10 THEN path END, ',' ORDER BY r) AS files,
         min(""" + S.pkey("path") + r""") AS first_key
  FROM ranked GROUP BY repo, layer
)
SELECT repo, layer, module_count, files,
       CAST(row_number() OVER (PARTITION BY repo ORDER BY module_count DESC, first_key) AS INTEGER) AS layer_rank
FROM agg""")
def q_layer_rollup(spark, d):
    files = corpus.dedupe_sorted(page_files(spark, d).select("repo", "path", "content"))
    return A.layer_rollup(files, sample=10).select(
        "repo", "layer", "module_count", F.array_join("files", ",").alias("files"), "layer_rank")


@register("line_table", "WITH " + S.DOC_LINES + "\nSELECT repo, path, line_no, line FROM doc_lines")
def q_line_table(spark, d):
    return corpus.line_table(doc_files(spark, d))


@register("file_line_counts", "WITH " + S.DOC_MODULES + "\nSELECT repo, path, n_lines FROM doc_modules")
def q_file_line_counts(spark, d):
    return corpus.modules_from_files(doc_files(spark, d))
