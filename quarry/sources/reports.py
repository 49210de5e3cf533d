"""Coverage XML source and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import split_rank


def scan_coverage_xml(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """Line records of Cobertura-style coverage XML files.

    Returns ``coverage(repo, filename, line_rate, has_line, line_no, hits,
    covered, doc_pos)``: one row per ``class/lines/line`` element (a missing
    number reads as 0; covered means the hits text is not "0"); a class
    without lines keeps one row with ``has_line = false``; ``line_rate`` is
    the class's ``line-rate`` attribute as given. ``doc_pos`` orders class elements by
    (file, position) so a repeated filename can be resolved "last wins".
    A missing path yields an empty table; any other failure is raised.
    """
    schema = ("`_filename` STRING, `_line-rate` DOUBLE, "
              "lines STRUCT<line: ARRAY<STRUCT<`_number`: BIGINT, `_hits`: STRING>>>")
    try:
        raw = (spark.read.format("xml").option("rowTag", "class")
               .option("mode", "DROPMALFORMED").schema(schema).load(path))
    except AnalysisException as error:  # missing path: the original tool returns no coverage
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(
            [], "repo string, filename string, line_rate double, has_line boolean, line_no int, "
                "hits long, covered boolean, doc_pos long")
    cls = raw.select(
        F.coalesce(F.lit(repo), F.input_file_name()).alias("repo"),
        F.col("_filename").alias("filename"),
        F.coalesce(F.col("`_line-rate`"), F.lit(0.0)).alias("line_rate"),
        F.col("lines.line").alias("ls"),
        F.monotonically_increasing_id().alias("doc_pos"),
    )
    hits = F.coalesce(F.col("l._hits"), F.lit("0"))
    return cls.select(
        "repo", "filename", "line_rate", "doc_pos",
        F.explode_outer("ls").alias("l"),
    ).select(
        "repo", "filename", "line_rate",
        # a class without lines keeps one row with has_line = false
        F.col("l").isNotNull().alias("has_line"),
        F.coalesce(F.col("l._number").cast("int"), F.lit(0)).alias("line_no"),
        F.coalesce(hits.cast("long"), F.lit(0)).alias("hits"),
        (hits != "0").alias("covered"),          # string test, as the report format is read
        "doc_pos",
    )


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Write a report table (one record per row; no single-document funnel)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``nth``, the number of the row among those of its key."""
    return split_rank(df, [key], [F.col(c) for c in order], "nth")


def write_documents(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One JSON array for each ``key``, its items in ``order`` (total within a key).

    Rows are range-partitioned by (key, order), so a key with most of the
    rows is written by many tasks; each writes its run of items to a part
    file below ``key=<key>``, committed by Spark's writer. The part files of
    a key, one after the other by name, are its document.
    """
    items = [c for c in df.columns if c != key]
    ranked = split_rank(df, [key], [F.col(c) for c in order], "_nth")
    n = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat(F.when(F.col("_nth") == 1, "[").otherwise(","), F.to_json(F.struct(*items)),
                    F.when(F.col("_nth") == F.col("_n"), "]").otherwise(""))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked.withColumn("_key", F.col(key)).join(n.withColumnRenamed(key, "_of"), F.col("_key").eqNullSafe(F.col("_of")))
    (rows.select(F.col("_key").alias(key), text.alias("value"), "_nth")
     .repartitionByRange(parts, key, "_nth").sortWithinPartitions(key, "_nth").drop("_nth")
     .write.mode("overwrite").partitionBy(key).text(path))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of :func:`write_documents`, one row each with the key's column."""
    item = F.from_json(F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\}\]$", "}"), schema)
    raw = spark.read.option("basePath", path).text(path)
    key = next(c for c in raw.columns if c != "value")
    return raw.select(key, item.alias("item")).select(key, "item.*")
