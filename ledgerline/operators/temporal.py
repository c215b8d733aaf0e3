"""Effective-dated, bi-temporal and as-of operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before its time (strictly before; or first at or after).

    One shuffle on the key: both sides are one stream ordered by time, and the last right row so far is carried along.
    Rows of the right side at one time are taken in the order of their values.
    """
    carried = F.struct(*[F.col(v).alias(v) for v in values], F.col(right_time).alias("matched_time"))
    first = 1 if strict or forward else 0  # where right rows stand among those of one time
    both = left.select(*on, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_r"), F.lit(1 - first).alias("_o")).unionByName(
        right.select(*on, F.col(right_time).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), carried.alias("_r"), F.lit(first).alias("_o"))
    )
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    w = Window.partitionBy(*on).orderBy(time, F.col("_o").desc() if forward else F.col("_o").asc(), F.col("_r").desc() if forward else F.col("_r").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_l is not null").select("_l.*", "_m.*")


def close_versions(frame: DataFrame, key: list[str], start: str, ties: list[str], end: str = "effective_to") -> DataFrame:
    """Adds the end of each version: the start of the next one of its key, null for the open one."""
    return frame.withColumn(end, F.lead(start).over(Window.partitionBy(*key).orderBy(start, *ties)))


def effective_at(facts: DataFrame, versions: DataFrame, on: list[str], date: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Facts with the version in force at their date, or nulls: the last version that starts at or before it, if it has not ended.

    Versions of a key follow each other; of several that start on one day the one that lasts is taken. One shuffle on the
    key, no join: an as-of merge.
    """
    values = [c for c in versions.columns if c not in on]
    open_ended = F.coalesce(F.col(end) > F.col(start), F.lit(True))
    met = as_of_join(facts, versions.filter(open_ended), on, date, start, values)
    alive = F.col(end).isNull() | (F.col(date) < F.col(end))
    return met.select(*facts.columns, *[F.when(alive & F.col("matched_time").isNotNull(), F.col(c)).alias(c) for c in values])


def latest(frame: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; partial maxima are taken before the shuffle."""
    return frame.groupBy(*key).agg(F.max_by(F.struct(*[c for c in frame.columns if c not in key]), F.struct(*order)).alias("_x")).select(*key, "_x.*")


def restatements(frame: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one stated before for the same key."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return frame.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def with_unknown(facts: DataFrame, members: DataFrame, key: str, unknown: int = -1) -> DataFrame:
    """Facts with the member key, or the reserved one where there is no such member, so that totals stay whole."""
    own = members.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    return facts.join(own, key, "left").withColumn("member", F.when(F.col("_known"), F.col(key)).otherwise(F.lit(unknown))).drop("_known")


def episodes(frame: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of consecutive rows on which the flag holds: adds ``episode``, the number of the run in its key."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = frame.withColumn("_f", flag).withColumn("_new", F.when(F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)), 1).otherwise(0))
    return marked.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_f").drop("_f", "_new")
