"""A corpus from raw documents: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage reads the whole output of the one before and returns the columns
of ``documents``; the last returns the training order. ``run`` writes every
stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from quarry.llm.tables import materialise, table, text_or_empty


def _text_mark() -> Column:
    return F.xxhash64(text_or_empty())


def _key(*columns: Column) -> Column:
    """One never-null column that is equal where all ``columns`` are, nulls included."""
    said = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *said))


def _one_row_each(docs: DataFrame, kept: DataFrame, docs_key: Column, kept_key: Column) -> DataFrame:
    """One row of ``docs`` for each key among ``kept``; rows are dealt out once for both steps."""
    keyed = docs.withColumn("__key", docs_key)
    first = (keyed.withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy(F.lit(0))))
             .filter("__nth = 1").drop("__nth"))
    return first.join(kept.select(kept_key.alias("__key")), "__key", "left_semi").drop("__key")


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told, or all if none could be learned; null texts and texts without a letter go."""
    profiles = language_id.learn_profiles(docs)
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.with_prediction(docs, profiles, "__found")
    return found.filter(F.col("__found.lang_pred") != language_id.UNDETERMINED).drop("__found")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (without white space) the longest, then the smallest id."""
    kept = exact_dedup.exact_groups(docs).filter("kept")
    length, content = F.char_length(text_or_empty()), F.sha2(exact_dedup.normalised(), 256)
    return _one_row_each(docs, kept, _key(F.col("doc_id"), length, content),
                         _key(F.col("doc_id"), F.col("length"), F.col("text_sha256")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8: the smallest id."""
    kept = near_dedup.near_duplicates(docs, words=5, percent=80).filter("kept")
    return _one_row_each(docs, kept, _key(F.col("doc_id"), _text_mark()), _key(F.col("doc_id"), F.col("text_mark")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    found = decontamination.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), near=False)
    hit = found.filter("contaminated").select(_key(F.col("doc_id"), F.col("text_mark")).alias("__key")).distinct()
    return docs.withColumn("__key", _key(F.col("doc_id"), _text_mark())).join(hit, "__key", "left_anti").drop("__key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with pass, words and position, one row for each reading, by position."""
    columns = docs.columns
    # rows of one id, text and source are told apart by number
    twin = F.row_number().over(W.partitionBy("__key").orderBy(F.lit(0)))
    keyed = docs.withColumn("__key", _key(F.col("doc_id"), _text_mark(), F.col("source"))).withColumn("__twin", twin)
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text"), keys=[_text_mark().alias("text_mark")])
    due = (mixed.select(_key(F.col("doc_id"), F.col("text_mark"), F.col("source")).alias("__key"), "passes")
           .withColumn("__due", F.row_number().over(W.partitionBy("__key").orderBy(F.lit(0))))
           .withColumn("__pass", F.explode("passes")).drop("passes"))
    read = keyed.join(due, "__key").filter(F.col("__twin") == F.col("__due"))
    new = ["pass", "words", "position"]
    return (read.select(*[c for c in columns if c not in new], *[F.col(f"__pass.{k}").alias(k) for k in new])
            .orderBy("position", "doc_id", "pass"))


STAGES = [
    ("language_id", detect_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A rejected language is a text without a letter, so every stage can be said in SQL.
ORACLE_SQL = r"""
WITH RECURSIVE s1 AS (SELECT * FROM documents WHERE regexp_matches(text, '\p{L}')),
s2 AS (SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')
                               ORDER BY length(text) DESC, doc_id NULLS LAST) AS nth FROM s1) WHERE nth = 1),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM s2),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
                           FROM sh x JOIN sh y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) c
         JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
s3 AS (SELECT * FROM s2 WHERE doc_id NOT IN (SELECT a FROM reach WHERE b < a)),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM s3),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ph AS (SELECT DISTINCT least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
       FROM (SELECT w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
hit AS (SELECT DISTINCT doc_id FROM (
          SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                FROM dw CROSS JOIN (SELECT DISTINCT n FROM ph) WHERE len(w) >= n)) JOIN ph USING (n, phrase)),
s4 AS (SELECT * FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM hit)),
d AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size, md5('mix' || '|' || doc_id) AS turn FROM s4),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
      FROM d GROUP BY source),
wt AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(nth - 1) % 3 + 1] AS weight,
              3 * source_size AS cap, cap / weight AS stop FROM t),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
              row_number() OVER (ORDER BY stop, nth) AS stop_no
       FROM wt WINDOW before AS (ORDER BY stop, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, source_size,
             floor(least(cap::DOUBLE, coalesce((SELECT level FROM lv WHERE level <= stop ORDER BY stop_no LIMIT 1) * weight,
                                               cap::DOUBLE)))::BIGINT AS goal,
             0.5::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * (nth - 1)::DOUBLE
                            / greatest(count(*) OVER () - 1, 1)::DOUBLE) AS slope FROM lv),
p AS (SELECT d.*, source_size, goal, slope, goal // source_size AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
r AS (SELECT *, least(greatest(goal - whole * source_size - before, 0), size) AS part FROM p),
e AS (SELECT *, unnest(range(0, whole + (part > 0)::INT)) AS pass FROM r),
g AS (SELECT *, (pass * source_size + before)::DOUBLE / goal::DOUBLE AS share FROM e)
SELECT doc_id, text, lang, source, n_chars, pass, (CASE WHEN pass < whole THEN size ELSE part END)::BIGINT AS words,
       CASE WHEN abs(slope) < 1e-12 THEN share ELSE
         ((1.0::DOUBLE + slope) - sqrt(greatest((1.0::DOUBLE + slope) * (1.0::DOUBLE + slope)
                                                - 4.0::DOUBLE * slope * share, 0.0::DOUBLE))) / (2.0::DOUBLE * slope) END AS position
FROM g
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
