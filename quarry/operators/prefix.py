"""Running sums that stay parallel when one group holds most rows.

A window ``sum() over (partition by g order by k)`` sorts each group in one
task. :func:`running_sum` range-partitions the rows on ``(g, k)`` so a hot group is spread over many
tasks, computes the local running sum of each slice in the task that holds
it, and adds the totals of the preceding slices of the same group (a small
table: one row per group and slice) with an equi-join. The scanned slices
are checkpointed once, so both consumers see the same slice boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                value_col: str, out_col: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Exact running sum of ``value_col`` per group in ``order_cols`` order.

    ``order_cols`` must make the order total within a group (ties would
    make any running sum order-dependent). Values are integral (long). The
    same plan runs at every size.
    """
    spark = df.sparkSession
    ship_package(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    ranged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_slice", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_local", T.LongType(), False)])
    gcols = list(group_cols)

    def local_scan(batches):
        # Rows arrive sorted by (group, order) within the slice; the running
        # total is carried across Arrow batches of the same slice.
        import pandas as pd
        carry_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_local=pd.Series([], dtype="int64"))
                continue
            k = pdf[gcols]
            gid = (k != k.shift()).any(axis=1).cumsum()
            local = pdf[value_col].fillna(0).astype("int64").groupby(gid).cumsum()
            first_key = tuple(k.iloc[0])
            if carry_key is not None and first_key == carry_key:
                local = local.where(gid != gid.iloc[0], local + carry)
            carry_key = tuple(k.iloc[-1])
            carry = int(local.iloc[-1])
            yield pdf.assign(_local=local.values)

    # Range bounds come from sampling, so every consumer must see the same
    # slices: materialise the scan once in the reliable checkpoint folder
    # (a cache could be recomputed with other bounds after an executor loss).
    scanned = cut_lineage(ranged.mapInPandas(local_scan, schema))
    totals = scanned.groupBy(*group_cols, "_slice").agg(F.sum(value_col).cast("long").alias("_slice_total"))
    wo = (Window.partitionBy(*group_cols).orderBy("_slice")
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, "_slice",
                            F.coalesce(F.sum("_slice_total").over(wo), F.lit(0)).alias("_offset"))
    out = scanned.join(offsets, group_cols + ["_slice"])
    return (out.withColumn(out_col, F.col("_local") + F.col("_offset"))
            .drop("_slice", "_local", "_offset"))


def split_rank(df: DataFrame, group_cols: list[str], order_cols: list[Column], out_col: str = "rank") -> DataFrame:
    """Row number per group in ``order_cols`` order (total within a group); a hot group is spread over tasks."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(ones, group_cols, order_cols, "_one", out_col).drop("_one")
