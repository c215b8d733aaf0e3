"""One-to-one matching of two sides of transactions: exact first, then inside a tolerance on amount and date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget, written


def match(left: DataFrame, right: DataFrame, key: list[str], amount: str, date: str, ident: str, tolerance: int, days: int) -> DataFrame:
    """left_id, right_id, stage, days and gap of each match; no row of a side is in two.

    Rows of equal key, amount and date are matched in the order of their ids (stage ``exact``). What is left is matched
    for each difference in days, the least first and earlier right sides before later ones, by amount alone: the rows of
    both sides of a key and day stand in one order of amounts, and where a left and a right row are next to each other and
    within the tolerance, they may match; of two such pairs that share a row the one with the smaller gap does, ties told
    by a hash. Matched rows go, others become neighbours, and rounds go on until no pair is left: every pair that could
    still match has one of its rows taken. Ties told by a hash keep the rounds few where many gaps are equal.

    A round is one sort by key and day, with a row before and after; no pairs are formed, however many rows an instrument
    has. Rounds of a shift hold only rows whose run, in which each amount follows the one before within the tolerance, has
    rows of both sides: no other row can match there. Rows with a null in key, amount or date match nothing.
    """
    complete = " and ".join(f"`{c}` is not null" for c in [*key, amount, date])
    side = lambda frame, n: frame.filter(complete).select(*key, F.col(amount).cast("long").alias("_a"), F.col(date).alias("_d"), F.col(ident).alias("_id"), F.lit(n).alias("_side"))
    both = written(side(left, 0).unionByName(side(right, 1)).withColumn("_row", F.monotonically_increasing_id()), "sides")
    nth = F.row_number().over(Window.partitionBy(*key, "_a", "_d", "_side").orderBy("_id", "_row"))
    numbered = both.repartition(*key, "_a", "_d").withColumn("_n", nth)  # numbering and pairing need no other shuffle
    twins = numbered.groupBy(*key, "_a", "_d", "_n").agg(F.max(F.when(F.col("_side") == 0, F.struct("_id", "_row"))).alias("l"), F.max(F.when(F.col("_side") == 1, F.struct("_id", "_row"))).alias("r"))
    twins = written(twins, "twins")
    found = [twins.filter("l is not null and r is not null").select(F.col("l._id").alias("left_id"), F.col("r._id").alias("right_id"), F.lit("exact").alias("stage"), F.lit(0).alias("days"), F.lit(0).cast("long").alias("gap"))]
    alone = F.coalesce(F.col("l"), F.col("r"))
    left_over = twins.filter("l is null or r is null").select(*key, "_a", "_d", F.when(F.col("l").isNull(), 1).otherwise(0).alias("_side"), alone["_id"].alias("_id"), alone["_row"].alias("_row"))
    gone: list[DataFrame] = []  # rows taken in rounds: a row a match and side, so what is left is told from them, not written again
    for shift in [x for d in range(days + 1) for x in ([-d, d] if d else [0])]:
        # a left row's day moves by the shift, so that a band is a key and a day of the right side
        band = F.when(F.col("_side") == 0, F.date_add("_d", shift)).otherwise(F.col("_d"))
        whole = Window.partitionBy(*key, "_band").orderBy("_a", "_side", "_row")
        begins = F.coalesce(F.col("_a") - F.lag("_a").over(whole) > tolerance, F.lit(True))
        rest = left_over.join(reduce(DataFrame.unionByName, gone), "_row", "left_anti") if gone else left_over
        runs = rest.withColumn("_band", band).withColumn("_begins", begins).withColumn("_run", F.count_if("_begins").over(whole))
        order, run = Window.partitionBy(*key, "_band", "_run").orderBy("_a", "_side", "_row"), Window.partitionBy(*key, "_band", "_run")
        mixed = runs.withColumns({"_least": F.min("_side").over(run), "_most": F.max("_side").over(run)}).filter("_least < _most")
        near = written(mixed.select(*key, "_band", "_run", "_a", "_side", "_id", "_row"), "near")
        while True:
            mine = F.struct("_side", "_a", "_id", "_row")
            placed = near.withColumn("_next", F.lead(mine).over(order))
            gap = F.col("_next._a") - F.col("_a")
            fits = (F.col("_next._side") != F.col("_side")) & (gap <= tolerance)
            rated = placed.withColumn("_rate", F.when(fits, F.struct(gap.alias("gap"), F.xxhash64("_row", "_next._row").alias("h"), F.col("_row").alias("row"))))
            before, after = F.lag("_rate").over(order), F.lead("_rate").over(order)
            wins = F.col("_rate").isNotNull() & (before.isNull() | (F.col("_rate") < before)) & (after.isNull() | (F.col("_rate") < after))
            met = rated.withColumn("_wins", wins).filter("_wins").select("_side", "_row", "_id", F.col("_next._row").alias("_row2"), F.col("_next._id").alias("_id2"), F.col("_rate.gap").alias("gap"))
            met = written(met, "met")
            if met.isEmpty():
                forget(met)
                break
            first = F.col("_side") == 0
            found.append(met.select(F.when(first, F.col("_id")).otherwise(F.col("_id2")).alias("left_id"), F.when(first, F.col("_id2")).otherwise(F.col("_id")).alias("right_id"), F.lit("tolerance").alias("stage"), F.lit(shift).alias("days"), "gap"))
            gone.append(met.select(F.explode(F.array("_row", "_row2")).alias("_row")))
            near = written(near.join(gone[-1], "_row", "left_anti"), "near", instead=near)
        forget(near)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = written(out, "matched")
    forget(both, twins)
    return out
