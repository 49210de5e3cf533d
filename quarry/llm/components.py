"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, written


@written("components")
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every linked id; the component is its smallest id.

    Each round gives an id the smallest label among itself and its
    neighbours and then the label of that label, so paths shorten by more
    than half. Rounds end when no label changes; labels are written to the
    shared folder after each. A busy id meets its neighbours as one sum per
    task, never in one group.
    """
    both = materialise(links.select(F.col(a).alias("id"), F.col(b).alias("other")).filter("id <> other")
                       .unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other")).filter("id <> other"))
                       .distinct(), "links")
    labels = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "labels")
    while True:
        offered = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(
            F.min("component").alias("offer"))
        nearer = labels.join(offered, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "offer").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        after = materialise(nearer.join(jump, "near", "left").select(
            "id", "old", F.least("near", F.coalesce("far", "near")).alias("component")), "labels")
        labels = after.select("id", "component")
        if after.filter("old <> component").isEmpty():
            return labels
