"""K1: threshold rules over a per-repo summary, one row per fired rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    value: str          # column of the summary holding the measured value
    op: str             # one of > >= < <= ==
    threshold: float
    when: str | None = None  # optional extra SQL predicate on the summary row


_OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def findings(summary: DataFrame, area: str, rules: list[Rule],
             key: str = "repo") -> DataFrame:
    """``(repo, area, rule, value, threshold)`` for each fired rule, in rule
    order; a single ``ok`` row for a repo where none fired.

    Pure projection: no join, no shuffle; the summary is already one row per
    repo.
    """
    fired = []
    for k, r in enumerate(rules):
        cond = _OPS[r.op](F.col(r.value).cast("double"), F.lit(float(r.threshold)))
        if r.when:
            cond = cond & F.expr(r.when)
        fired.append(F.when(cond, F.struct(
            F.lit(k).alias("ord"), F.lit(r.name).alias("rule"),
            F.col(r.value).cast("double").alias("value"),
            F.lit(float(r.threshold)).alias("threshold"))))
    ok = F.struct(F.lit(len(rules)).alias("ord"), F.lit("ok").alias("rule"),
                  F.lit(None).cast("double").alias("value"),
                  F.lit(None).cast("double").alias("threshold"))
    arr = F.array_compact(F.array(*fired))
    arr = F.when(F.size(arr) == 0, F.array(ok)).otherwise(arr)
    return (summary.select(F.col(key), F.explode(arr).alias("f"))
            .select(key, F.lit(area).alias("area"), F.col("f.ord").alias("rule_ord"),
                    "f.rule", "f.value", "f.threshold"))
