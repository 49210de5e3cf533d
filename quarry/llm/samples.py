"""Rows to learn from: all of given ids, or bounded samples chosen by hashes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Words that all rows to learn from have together at most.
TOTAL_WORDS = 8_000_000
#: Bits of the bitmap for each id that is looked for.
ID_BITS = 16
#: How many times the wanted ids pass the first cut, and how many more.
SLACK, LEAST = 1.5, 100


def _rank(column: str) -> Column:
    """A hash of the id from 0 to 1."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def lowest_ids(ids: DataFrame, sample: int, n_ids: int) -> DataFrame:
    """The at most ``sample`` different ``doc_id`` of ``ids`` with the lowest hashes, of about ``n_ids`` that there are.

    A cut by the hash comes first, so that no task passes on many more rows
    than are wanted.
    """
    cut = (SLACK * sample + LEAST) / max(n_ids, 1)
    few = ids.filter(_rank("doc_id") < cut) if cut < 1 else ids
    return few.distinct().orderBy(_rank("doc_id"), "doc_id").limit(sample)


def likely(rows: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """All rows whose ``doc_id`` is among ``ids``, and about one of ``ID_BITS`` other rows.

    A bitmap of the ids' hashes goes to the tasks, so that a join with
    ``ids`` need not deal out the texts of all rows.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS * max(n_ids, 1))) + 1
    at = F.bitmap_bit_position(place)
    maps = (ids.select(F.bitmap_bucket_number(place).alias("__bucket"), at.alias("__at")).groupBy("__bucket")
            .agg(F.bitmap_construct_agg("__at").alias("__bits")))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__bucket")
    return marked.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*rows.columns)


def one_row_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each ``doc_id`` of ``rows``: that with the lowest hash of its text."""
    first = F.min(F.struct(F.xxhash64("text").alias("__mark"), *columns))
    return rows.groupBy("doc_id").agg(first.alias("first")).select(*[f"first.{c}" for c in columns])


def bounded(rows: DataFrame, most_words: int, words_per_id: int = 1, order: tuple[str, ...] = ()) -> pa.Table:
    """``rows`` (with ``ids``, the words) of 1 to ``most_words`` words by hash, ``TOTAL_WORDS`` together at most."""
    kept = materialise(rows.filter(F.size("ids").between(1, words_per_id * most_words))
                       .withColumn("__mark", F.xxhash64("ids")), "rows-to-learn")
    total, last = 0, None
    for r in kept.select("__mark", F.size("ids").alias("n")).orderBy("__mark").collect():
        total += r.n
        if total > words_per_id * TOTAL_WORDS:
            break
        last = r["__mark"]
    if last is None:
        kept = kept.limit(0)
    return kept.filter(F.col("__mark") <= F.lit(last if last is not None else 0)).orderBy("__mark", *order).drop("__mark").toArrow()
