"""Sources and sinks, there and back: tables are written as files in the shared folder and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as CV
from ..session import cut_lineage
from ..sources import corpus, ranges, reports
from . import sql_common as S
from .registry import register
from .tables import customer_files, table


def _written(spark, d):
    """Each document as a file: repo = source, path = lang/doc_id.txt."""
    docs = table(spark, d, "documents").select(
        F.coalesce("source", F.lit("none")).alias("repo"),
        F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"))
    root = ranges.new_folder(spark, "files")
    ranges.write_files(docs, root)
    return root


SQL_FILES = r"""
files AS (
  SELECT coalesce(source, 'none') AS repo, coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
)"""


@register("scan_files", "WITH " + SQL_FILES + r"""
SELECT repo, path, md5(text) AS content_md5, CAST(length(text) AS INTEGER) AS n_chars FROM files""")
def q_scan_files(spark, d):
    files = corpus.scan_corpus(spark, _written(spark, d), include=["**/*.txt"])
    return files.select("repo", "path", F.md5("content").alias("content_md5"), F.char_length("content").alias("n_chars"))


@register("scan_lines", "WITH " + SQL_FILES + r""",
parts AS (SELECT repo, path, string_split(text, chr(10)) AS arr FROM files),
trimmed AS (SELECT repo, path, CASE WHEN arr[-1] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM parts)
SELECT repo, path, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line FROM trimmed""")
def q_scan_lines(spark, d):
    return corpus.scan_lines(spark, _written(spark, d), include=["**/*.txt"])


def _coverage_xml(spark, d):
    """Coverage reports per nation: a customer's events are lines, those of even ids in one class element, the others in a
    later one of the same file name."""
    files = customer_files(spark, d)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    hit = F.when(F.col("event_type").isin("purchase", "signup"), "1").otherwise("0")
    odd = F.col("event_id") % 2
    line = F.format_string('<line number="%d" hits="%s"/>', F.col("event_id"), hit)
    of_class = (e.join(files, e.user_id == files.c_custkey).groupBy("repo", "path", "c_custkey", odd.alias("odd"))
                .agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", line.alias("x"))))["x"], "\n").alias("lines"),
                     F.count(F.lit(1)).alias("n")))
    # a report file holds the customers of one hundred; a customer's second element comes after its first
    element = F.format_string('<class filename="%s" line-rate="0.%d"><lines>\n%s\n</lines></class>', "path", F.col("odd") + 1, "lines")
    body = F.array_join(F.array_sort(F.collect_list(F.struct("odd", "c_custkey", element.alias("x"))))["x"], "\n")
    return (of_class.groupBy("repo", F.floor(F.col("c_custkey") / 100).alias("k")).agg(body.alias("body"))
            .select("repo", F.format_string("coverage%06d.xml", "k").alias("path"),
                    F.concat(F.lit('<?xml version="1.0" ?>\n<coverage><packages><package><classes>\n'), "body",
                             F.lit("\n</classes></package></packages></coverage>\n")).alias("content")))


@register("coverage_xml", "WITH " + S.CUSTOMER + r""",
lines AS (SELECT *, line_no % 2 AS odd FROM cov_rows),
last AS (SELECT repo, filename, max(odd) AS odd FROM lines GROUP BY repo, filename)
SELECT l.repo, l.filename, count(*) FILTER (hits <> 0) AS lines_covered, count(*) AS lines_total,
       CASE WHEN l.odd = 1 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS line_rate,
       coalesce(string_agg(CASE WHEN hits = 0 THEN line_no::VARCHAR END, ',' ORDER BY line_no), '') AS uncovered
FROM lines l JOIN last USING (repo, filename, odd) GROUP BY l.repo, l.filename, l.odd""")
def q_coverage_xml(spark, d):
    root = ranges.new_folder(spark, "coverage")
    ranges.write_files(_coverage_xml(spark, d), root)
    found = ranges.scan_coverage_ranges(root, corpus.list_paths(spark, root), range_bytes=1 << 16)
    per_file = CV.coverage_per_file(cut_lineage(found))
    return per_file.select("repo", "filename", "lines_covered", "lines_total", "line_rate",
                           F.array_join("uncovered_lines", ",").alias("uncovered"))


@register("report_documents", r"""
SELECT o_orderpriority AS repo, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth,
       o_orderkey, o_totalprice, o_orderstatus FROM orders""")
def q_report_documents(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("repo"), "o_orderkey", "o_totalprice", "o_orderstatus")
    path = ranges.new_folder(spark, "documents")
    ranked = reports.numbered(orders, "repo", ["o_orderkey"])
    reports.write_documents(ranked, path, "repo", ["nth"])
    return reports.read_documents(spark, path, "nth long, o_orderkey long, o_totalprice double, o_orderstatus string")
