"""The operators of this package bound to the given tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, exact_dedup, language_id, lexical, mixing, near_dedup, pii, quality, repeated_windows, secrets,
               token_counts, toxicity, whitening)
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


# kind, pattern, condition on x.hit / x.digits / x.alone / x.near
_SPANS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 "
     "AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))"),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), "
     "lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INT "
     "ELSE (2 * substr(reverse(digits), i, 1)::INT) // 10 + (2 * substr(reverse(digits), i, 1)::INT) % 10 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "alone AND near"),
]


def _span_sql(place: int, kind: str, pattern: str, condition: str) -> str:
    words = pii.KINDS[kind][2]
    return f"""
    SELECT doc_id, {place} AS place, '{kind}' AS kind, e - length(hit) AS s, e,
           {condition} AS good
    FROM (SELECT doc_id, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
                 list_sum(list_transform(gaps[:i], lambda g: length(g)))
                 + list_sum(list_transform(hits[:i], lambda h: length(h))) AS e,
                 NOT regexp_matches(gaps[i], '[A-Za-z0-9]$') AND NOT regexp_matches(gaps[i + 1], '^[A-Za-z0-9]') AS alone,
                 regexp_matches(right(gaps[i], 40) || ' ' || left(gaps[i + 1], 40), '(?i)\\b({words})\\b') AS near
          FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
                       unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i
                FROM texts))"""


_MOD97 = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace({x}, ' ', ''), 5) || "
          "substr(replace({x}, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN 100 + ascii(c) - 55 ELSE c::BIGINT END)), "
          "lambda a, v: CASE WHEN v >= 100 THEN (a * 100 + v - 100) % 97 ELSE (a * 10 + v) % 97 END) = 1")
# an account number may start at each capital that follows no letter or digit: its longest form if nothing of its kind
# follows, else the longest of its starts of whole groups that passes; none within an earlier one
_ACCOUNTS = f"""
place AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS pos FROM texts WHERE regexp_matches(t, '[A-Z][A-Z][0-9][0-9]')),
proposal AS (
  SELECT doc_id, t, pos, regexp_extract(substr(t, pos),
    '^[A-Z][A-Z][0-9]{{2}}([A-Z0-9]{{11,30}}|(\x20[A-Z0-9]{{4}}){{2,7}}(\x20[A-Z0-9]{{1,3}})?)') AS longest
  FROM place WHERE substr(t, pos, 1) BETWEEN 'A' AND 'Z' AND NOT regexp_matches(substr(t, greatest(pos - 1, 1), (pos > 1)::INT), '[A-Za-z0-9]')),
form AS (
  SELECT doc_id, pos, longest AS x, NOT regexp_matches(substr(t, pos + length(longest), 1), '[A-Za-z0-9]') AS may FROM proposal WHERE longest <> ''
  UNION ALL
  SELECT doc_id, pos, substr(longest, 1, 4 + 5 * n), substr(longest, 5, 1) = ' ' AND length(longest) > 4 + 5 * n
  FROM (SELECT *, unnest(range(2, 8)) AS n FROM proposal WHERE longest <> '')),
account AS (SELECT doc_id, pos, max(pos + length(x)) AS stop FROM form WHERE may AND {_MOD97.format(x="x")} GROUP BY doc_id, pos)"""


ORACLES["op3_pii"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_ACCOUNTS.strip()},
spans AS ({" UNION ALL ".join(_span_sql(i if i < 4 else 5, *s) for i, s in enumerate(_SPANS))}
  UNION ALL
  SELECT doc_id, 4, 'iban', pos - 1, stop - 1, true FROM (
    SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM account)
  WHERE reached IS NULL OR stop > reached),
per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
               count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
               coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) FILTER (place < 4), '') AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) AS spans
        FROM spans WHERE good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_mark")


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.repeated_windows(table(spark, sf_dir, "documents"), window=400, words=50)


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("length")


ORACLES["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
r AS (SELECT doc_id, c, row_number() OVER g AS nth, first_value(doc_id) OVER g AS keep_id,
             count(*) OVER (PARTITION BY c) AS group_size
      FROM n WINDOW g AS (PARTITION BY c ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(c) AS text_sha256 FROM r
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    # in training order by a document's first reading; those never read come last
    due = mixed.withColumn("due", F.get("passes", F.lit(0))["position"])
    return due.orderBy(due["due"].asc_nulls_last(), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", F.col("due").alias("position"))


ORACLES["op8_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix' || coalesce('|' || doc_id, '')) AS turn FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
      FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(nth - 1) % 3 + 1] AS weight,
             3 * source_size AS cap, cap / weight AS stop FROM t),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
             row_number() OVER (ORDER BY stop, nth) AS stop_no
      FROM w WINDOW before AS (ORDER BY stop, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(
             (SELECT level FROM l WHERE level <= stop ORDER BY stop_no LIMIT 1) * weight, cap::DOUBLE)) AS target,
             0.5::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * (nth - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1)::DOUBLE) AS slope FROM l),
p AS (SELECT d.doc_id, size, source_size, target, slope, floor(target)::BIGINT AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, least(greatest(goal - whole * source_size - before, 0), size) AS part, before::DOUBLE / goal::DOUBLE AS share FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + part)::BIGINT AS taken,
       CASE WHEN size > 0 AND (whole > 0 OR part > 0) THEN
         CASE WHEN abs(slope) < 1e-12 THEN share ELSE
           ((1.0::DOUBLE + slope) - sqrt(greatest((1.0::DOUBLE + slope) * (1.0::DOUBLE + slope)
                                                  - 4.0::DOUBLE * slope * share, 0.0::DOUBLE))) / (2.0::DOUBLE * slope) END END AS position
FROM k
"""


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs.select("doc_id", "text"), items).drop("text_mark")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op10_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
h AS (SELECT doc_id, s, n, item_id
      FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                  FROM d CROSS JOIN (SELECT DISTINCT n FROM p) WHERE len(w) >= n))
      JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
n AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
pw AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ws FROM p),
pp AS (SELECT phrase, ws, list_sort(list_filter(list_transform(range(1, len(ws) + 1), lambda k: (g[k], ws[k], k)), lambda x: x[1] IS NOT NULL)) AS known
       FROM (SELECT phrase, ws, list(n ORDER BY k) AS g FROM (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS k FROM pw) LEFT JOIN n ON t = ws[k]
             GROUP BY phrase, ws)),
pr AS (SELECT phrase, list_distinct(ws) AS ws, known[1][2] AS t1, known[least(2, len(known))][2] AS t2 FROM pp WHERE len(known) > 0),
dp AS (SELECT doc_id, w, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM d),
nr AS (SELECT DISTINCT doc_id, phrase FROM (
         SELECT doc_id, phrase, ws, w[greatest(pos - 20, 1):greatest(pos - 20, 1) + 40] AS around, w[greatest(pos - 20, 1):pos + 20] AS close, t2
         FROM dp JOIN pr ON t = t1 WHERE t1 <> t2)
       WHERE list_contains(close, t2) AND len(list_intersect(ws, around)) * 100 >= len(ws) * 80),
e AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (
        SELECT doc_id, item_id::VARCHAR AS item FROM h UNION SELECT doc_id, item_id::VARCHAR FROM nr JOIN p USING (phrase)) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id)
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nth, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
all_docs AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT nth, t, count(*) AS tf FROM (SELECT nth, unnest(w) AS t FROM d) GROUP BY nth, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT item_id, t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
       FROM q JOIN df USING (t), all_docs),
m AS (SELECT doc_id, nth, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, all_docs WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, nth, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM wt JOIN tf USING (t) JOIN m USING (nth) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))
