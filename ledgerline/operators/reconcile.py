"""Reconciliation of two sides, tolerance breaks and largest-remainder allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: list[str], value: str, tolerance: int) -> DataFrame:
    """A row for each key of either side: both values, the difference and its cause."""
    a = left.select(*key, F.col(value).alias("left_value"))
    b = right.select(*key, F.col(value).alias("right_value"))
    diff = F.coalesce("left_value", F.lit(0)) - F.coalesce("right_value", F.lit(0))
    cause = F.when(F.col("left_value").isNull(), "missing_left").when(F.col("right_value").isNull(), "missing_right").when(F.abs(diff) > tolerance, "break").when(diff != 0, "within_tolerance").otherwise("match")
    return a.join(b, key, "full_outer").withColumns({"difference": diff, "cause": cause})


def allocate(frame: DataFrame, group: list[str], weight: str, amount: str, ties: list[str]) -> DataFrame:
    """Splits each group's amount by weights into whole units; what rounding leaves goes to the largest weight."""
    w = Window.partitionBy(*group)
    share = F.floor(F.col(amount) * F.col(weight) / F.sum(weight).over(w)).cast("long")
    split = frame.withColumn("share", share)
    rank = F.row_number().over(w.orderBy(F.desc(weight), *ties))
    rest = F.col(amount) - F.sum("share").over(w)
    return split.withColumn("_rest", rest).withColumn("_rank", rank).withColumn("share", F.col("share") + F.when(F.col("_rank") == 1, F.col("_rest")).otherwise(0)).drop("_rest", "_rank")
