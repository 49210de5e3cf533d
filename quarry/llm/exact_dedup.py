"""Exact dedup by sorting the contents.

Sampled splitters range-partition the normalised texts, each partition is
sorted (spilling as it needs), equal texts are then neighbours and are
compared in full. Splitters are made of the texts' first characters and their
hash, so the sample that the driver sees stays small. A group that holds more than a small share of all rows is
split over the partitions by a hash of its ids first; its parts meet again as
one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WHITE, materialise, shuffle_partitions, text_or_empty, written

#: Characters of a text that a splitter holds.
PREFIX = 32


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE, "")


@written("exact-result")
def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), length.

    Two texts are equal when they are the same after all spaces and control
    characters 9 to 13 are deleted; null counts as empty. Of equal texts the
    row stays that has the most code points, then the smallest doc_id; a null
    id comes last. Of rows with the same id and equally long equal texts one
    stays. Only doc_id and the text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    whole = text_or_empty(text)
    normal = materialise(
        docs.select("doc_id", F.char_length(whole).alias("length"), normalised(text).alias("content"))
        .withColumn("mark", F.xxhash64("content")), "exact-content")
    # groups with over 1 / (4n) of all rows: 4n at most, whatever the input
    marks = normal.groupBy("mark").agg(F.count(F.lit(1)).alias("rows"))
    large = (marks.filter((F.col("rows") * F.lit(4 * n) > F.lit(normal.count())) & (F.col("rows") > 1))
             .select(F.col("mark").alias("large")))
    spread = F.when(F.col("large").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.lit(0))
    ranged = (normal.join(F.broadcast(large), F.col("mark") == F.col("large"), "left")
              .select("doc_id", "length", F.left("content", F.lit(PREFIX)).alias("start"), "mark", spread.alias("part"), "content")
              .repartitionByRange(n, "start", "mark", "part"))
    best_first = (F.col("length").desc(), F.col("doc_id").asc_nulls_last())
    neighbours = W.partitionBy("start", "mark", "part", "content").orderBy(*best_first)
    rows = materialise(ranged.select(
        "doc_id", "length", F.sha2("content", 256).alias("text_sha256"),
        F.row_number().over(neighbours).alias("nth")), "exact-rows")
    best = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    # written, so that the join below has plain inputs and Spark can split a large group's rows
    groups = materialise(rows.groupBy(F.col("text_sha256").alias("of")).agg(
        F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    return rows.join(groups, F.col("text_sha256") == F.col("of")).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size",
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("best.id"))
         & (F.col("length") == -F.col("best.shorter"))).alias("kept"), "text_sha256", "length")
