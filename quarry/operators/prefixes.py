"""Which strings start with one of many names, by one sort.

In sorted order everything that starts with a name follows it at once, up to
the first string that does not. So one scan that remembers the open name, the
shortest one that the present string starts with, answers for all. Slices of
a range partitioning are scanned each for themselves; what is open at the end
of a slice is carried into the next ones by a table of one row a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``open``: the shortest name of the slice that the row's value starts with, itself for an uncovered name."""
    at = None
    for batch in batches:
        out = []
        for grp, value, is_name in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if at is not None and not (grp == at[0] and value.startswith(at[1])):
                at = None
            if at is None and is_name:
                at = (grp, value)
            out.append(at[1] if at else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "open"])


def starting_with(targets: DataFrame, names: DataFrame, group: str, target: str, name: str,
                  slices: int | None = None) -> DataFrame:
    """Distinct ``(group, target)`` of ``targets`` that start with some ``name`` of the same group.

    An empty name covers its whole group; null groups, targets and names
    count for nothing.
    """
    spark = targets.sparkSession
    ship_package(spark)
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (names.select(F.col(group).alias("grp"), F.col(name).alias("value"), F.lit(True).alias("is_name"))
            .unionByName(targets.select(F.col(group).alias("grp"), F.col(target).alias("value"), F.lit(False).alias("is_name")))
            .dropna().distinct())
    rows = written(rows)  # the range partitioning reads it twice, for its bounds and for its rows
    order = [F.col("grp"), F.col("value"), F.col("is_name").desc()]
    # written, so that both uses see the same slices
    scanned = written(rows.repartitionByRange(n, "grp", "value").sortWithinPartitions(*order)
                      .withColumn("slice", F.spark_partition_id())
                      .mapInArrow(_scan, "grp string, value string, is_name boolean, slice int, open string"))
    last = F.max(F.struct("grp", "value", F.lit(1).alias("one"), "open"))
    ends = scanned.groupBy("slice").agg(last.alias("e")).orderBy("slice").collect()  # one row a slice
    carried, held = [], None
    for r in ends:
        carried.append((r.slice, *(held or (None, None))))
        covered = held is not None and r.e.grp == held[0] and r.e.value.startswith(held[1])
        if not covered:
            held = (r.e.grp, r.e.open) if r.e.open is not None else None
    before = spark.createDataFrame(carried, "slice int, held_grp string, held string")
    from_before = (F.col("grp") == F.col("held_grp")) & F.col("value").startswith(F.col("held"))
    found = scanned.where("NOT is_name").join(before, "slice")
    return (found.where(F.col("open").isNotNull() | F.coalesce(from_before, F.lit(False)))
            .select(F.col("grp").alias(group), F.col("value").alias(target)))
