"""Dictionaries as tables. Binding: the words of the benchmark items of three letters and more are the tokens,
their first two letters the keys, their alphabetical order the dictionary's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators.prefix import split_rank
from ..session import cut_lineage
from ..sources import corpus
from . import sql_common as S
from .registry import register
from .tables import conversation_tasks, doc_files, doc_words, table


def _dictionary(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    tokens = table(spark, d, "benchmark").select(words.alias("token"), F.lit(0).alias("all")).distinct()
    ranked = split_rank(tokens, ["all"], [F.col("token")], "ord")
    return cut_lineage(ranked.select(F.substring("token", 1, 2).alias("key"), "token", "ord"))


SQL_DICT = r"""
dict AS (
  SELECT token, left(token, 2) AS key, row_number() OVER (ORDER BY token) AS ord
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark)
)"""


@register("prefix_dict_table", "WITH " + S.DOC_WORDS + "," + SQL_DICT + r""",
named AS (SELECT DISTINCT repo, path, name FROM doc_words),
hit AS (SELECT DISTINCT n.name, d.key FROM (SELECT DISTINCT name FROM named) n JOIN dict d ON starts_with(n.name, d.token))
SELECT DISTINCT repo, path, key AS framework FROM named JOIN hit USING (name)""")
def q_prefix_dict_table(spark, d):
    imports = doc_words(spark, d).select("repo", "path", F.col("name").alias("module"))
    return D.match_prefixes(imports, _dictionary(spark, d))


@register("token_dict_table", "WITH " + S.DOC_LINES + "," + SQL_DICT + r"""
SELECT repo, path, line_no AS line, 'word' AS type, arg_min(token, ord) AS operation
FROM doc_lines JOIN dict ON contains(line, token) GROUP BY repo, path, line_no""")
def q_token_dict_table(spark, d):
    return D.first_token_table(corpus.line_table(doc_files(spark, d)), _dictionary(spark, d), None, "word")


@register("keyword_dict_table", "WITH " + SQL_DICT + r"""
SELECT t.task_id, count(d.token) AS n_keywords, coalesce(string_agg(d.token, ',' ORDER BY d.token), '') AS keywords
FROM (SELECT conv_id || ':' || turn AS task_id, text FROM conversations WHERE role = 'user') t
LEFT JOIN dict d ON contains(lower(t.text), d.token) GROUP BY t.task_id""")
def q_keyword_dict_table(spark, d):
    held = D.keywords_table(conversation_tasks(spark, d).select("task_id", "text"), _dictionary(spark, d))
    return held.select("task_id", F.size("keywords").cast("long").alias("n_keywords"), F.array_join("keywords", ",").alias("keywords"))
