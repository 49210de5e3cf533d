"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes linearly over training time. Its
integral is the source's weight in the whole mix and so its target; the
schedule's cumulative demand, inverted, tells at which training time a
document's first word is due. Documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WORD, materialise, shuffle_partitions, text_or_empty, written


def document_sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3,
                   ramp: float = 0.5) -> DataFrame:
    """``source, source_size`` -> the same with ``target`` and ``slope``, one row per source.

    The targets share the sum of all sizes by weight; a source that would
    pass ``max_repeat`` times its size stops there and its excess is shared
    again by weight, until no source is above. In order of the level (size
    limit over weight) at which a source stops, the final level is that of
    the first source which need not stop. ``slope`` is the curriculum: the
    source's weight falls over time where it is positive. Works on one row
    per source.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    by_stop = W.orderBy("stop", "nth")
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = (totals.withColumn("nth", F.row_number().over(by_source))
         .withColumn("weight", F.element_at(cycle, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(max_repeat))
         .withColumn("stop", F.col("cap") / F.col("weight"))
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("n_sources", F.count(F.lit(1)).over(everything))
         .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(everything)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left_size") / F.col("left_weight"))
         .withColumn("at", F.row_number().over(by_stop)))
    free = F.when(F.col("level") <= F.col("stop"), F.struct("at", "level"))
    t = t.withColumn("final", F.min(free).over(everything)["level"])
    even = (F.lit(1.0) - F.lit(2.0) * (F.col("nth") - 1) / F.greatest(F.col("n_sources") - 1, F.lit(1)))
    return t.select("source", "source_size",
                    F.least(F.col("cap").cast("double"),
                            F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
                    (F.lit(float(ramp)) * even).alias("slope"))


def due_time(share: Column, slope: Column) -> Column:
    """The time in [0, 1] at which ``share`` of a source's demand has been taken.

    The weight is w * (1 + a * (1 - 2t)); its integral (1 + a)t - at^2 is
    solved for t.
    """
    b = F.lit(1.0) + slope
    root = F.sqrt(F.greatest(b * b - F.lit(4.0) * slope * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, share).otherwise((b - root) / (F.lit(2.0) * slope))


@written("mix-result")
def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3,
                ramp: float = 0.5, seed: str = "mix", keys: Sequence[Column] = ()) -> DataFrame:
    """One row per document: what the mix takes of it and when.

    ``docs`` needs doc_id, source and text; ``keys`` are further columns to
    carry. Returned: doc_id, source, keys, size, source_size, target, taken
    and ``passes``, an array with one entry (pass, words, position) for each
    time that the document is read.

    A source is read in the order of a hash of the id, as often as its
    target needs; the last pass ends inside a document, which then gives its
    first words only. So a source's taken words are its target rounded down,
    and a document gives at most ``max_repeat`` times its size. A null or
    empty text has size 0 and no passes; a null source is a source of its
    own, the last; a null id is ordered as an empty one; repeated rows count
    as separate documents. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    blocks = 4 * shuffle_partitions(spark)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    # 24 bits of the hash place a document in one of `blocks` runs of the order
    run = F.floor(F.conv(F.substring("turn", 1, 6), 16, 10).cast("long") * F.lit(blocks) / F.lit(1 << 24))
    sized = materialise(
        docs.select("doc_id", "source", *keys, document_sizes(docs).alias("size"), order.alias("turn"))
        .withColumn("run", run), "mix-sizes")
    # the sum before a document: all earlier runs of its source, then its own run
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    earlier = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select("source", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_start"))
    totals = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    starts = starts.alias("s").join(
        source_targets(totals, weights, max_repeat, ramp).alias("t"),
        F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select(F.col("s.source").alias("of"), F.col("run").alias("of_run"), "run_start", "source_size", "target", "slope")
    inside = W.partitionBy("source", "run").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (sized.withColumn("before_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")), "left")
              .withColumn("before", F.col("run_start") + F.col("before_run"))
              .withColumn("goal", F.floor("target").cast("long"))
              .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size")))
                          .otherwise(F.lit(0)).cast("long"))
              .withColumn("part", F.least(F.greatest(
                  F.col("goal") - F.col("full") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))))
    words = lambda i: F.when(i < F.col("full"), F.col("size")).otherwise(F.col("part"))
    reads = F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)
    passes = F.when((F.col("size") > 0) & (reads > 0), F.transform(
        F.sequence(F.lit(0).cast("long"), reads - 1),
        lambda i: F.struct(i.alias("pass"), words(i).alias("words"), due_time(
            (i * F.col("source_size") + F.col("before")) / F.col("goal"), F.col("slope")).alias("position"))))
    carried = [c for c in sized.columns if c not in ("doc_id", "source", "size", "turn", "run")]
    return placed.select(
        "doc_id", "source", *carried, "size", "source_size", "target",
        (F.col("full") * F.col("size") + F.col("part")).alias("taken"),
        F.coalesce(passes, F.array().cast("array<struct<pass:bigint,words:bigint,position:double>>")).alias("passes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per read document and pass, range-sorted by training position."""
    kept = [c for c in mixed.columns if c != "passes"]
    return (mixed.select(*kept, F.explode("passes").alias("p"))
            .select(*kept, F.col("p.pass").alias("pass"), F.col("p.words").alias("words"),
                    F.col("p.position").alias("position"))
            .orderBy("position", "doc_id", "pass"))
