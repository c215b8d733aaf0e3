"""Ranks and running sums over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def in_order(frame: DataFrame, by: list[str], total: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1, equal rows alike), ``rows`` (of all) and, of a column, ``running`` (its sum up to the row).

    Rows are dealt by ranges of the order and written, so that a range keeps its number; each range is ranked for itself
    and moved by what the ranges before it hold, which is one row a range. Equal keys are always in one range; for running
    sums the order should have no ties.
    """
    dealt = written(frame.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = [F.count("*").alias("_n"), (F.sum(total) if total else F.lit(0)).alias("_s")]
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = dealt.groupBy("_range").agg(*sums)
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), F.sum("_n").over(every).alias("rows"))
    own = Window.partitionBy("_range").orderBy(*by)
    out = dealt.join(F.broadcast(offsets), "_range").withColumn("rank", F.rank().over(own) + F.col("_rows"))
    if total:
        out = out.withColumn("running", F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum"))
    return out.drop("_range", "_rows", "_sum")


def in_groups(frame: DataFrame, group: list[str], by: list[Column]) -> DataFrame:
    """Adds, in each group, ``row`` (from 1, each row its own), ``rank`` (equal rows alike) and ``rows`` (of the group).

    For groups that may hold a large part of all rows: rows are dealt by ranges of group and order together, so a group
    lies in many ranges, and each range is numbered for itself. A row moves by what the ranges before it hold of its group,
    which is one row a range and group that meets there. Equal keys are in one range.
    """
    order = [F.struct(*by).alias("_order")] if len(by) > 1 else [by[0].alias("_order")]
    # a struct has one direction; callers turn numbers round for the other
    dealt = written(frame.select("*", *order).repartitionByRange(*group, "_order").withColumn("_range", F.spark_partition_id()), "groups")
    held = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    offsets = held.select(*group, "_range", F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("rows"))
    own = Window.partitionBy("_range", *group).orderBy("_order")
    met = dealt.join(offsets, [*group, "_range"])
    return met.withColumns({"row": F.row_number().over(own) + F.col("_before"), "rank": F.rank().over(own) + F.col("_before")}).drop("_range", "_before", "_order")


def ntile(row: Column, rows: Column, n: int) -> Column:
    """Which of n parts, as even as can be and larger ones first, a row of a group is in."""
    small, more = F.floor(rows / n), rows % n
    return F.when(row <= more * (small + 1), F.floor((row - 1) / (small + 1))).otherwise(F.floor((row - 1 - more) / F.greatest(small, F.lit(1)))) + 1


def percent_rank(frame: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the share of other rows that come before, by one column."""
    return in_order(frame, [by]).withColumn(name, F.when(F.col("rows") > 1, (F.col("rank") - 1) / (F.col("rows") - 1)).otherwise(F.lit(0.0))).drop("rank", "rows")
