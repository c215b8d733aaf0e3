"""Distribution waterfalls, whole-fund and deal by deal, as running shortfalls instead of a loop over deals; commitments projected over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortfall(owed: Column, paid: Column, key: list[str], order: list[str]) -> Column:
    """What is owed and not yet paid after each row: ``max(0, before + owed - paid)``, from zero, in the order of a key.

    In closed form: the running sum of what is added, less its least value so far where that is below zero.
    """
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(owed - paid).over(running)


def _floor(total: str, key: list[str], order: list[str]) -> Column:
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(total) - F.least(F.lit(0), F.min(total).over(running))


def waterfall(deals: DataFrame, key: list[str], order: list[str], capital: str, preferred: str, proceeds: str, carry: int = 20) -> DataFrame:
    """Adds to each realised deal what its proceeds pay: returned, preferred_paid, catch_up, carried and to_investors.

    ``capital`` and ``preferred`` are what a deal adds to what investors are owed, ``proceeds`` what it brings, in whole
    cents. Proceeds return capital first, that of earlier deals at a loss included; then the preferred return; then the
    manager catches up to ``carry`` percent of what was paid as profit; the rest is split. Losses and unpaid parts go on
    to the key's later deals. With each deal's own capital at its exit this is the deal-by-deal (American) waterfall; with
    all capital at the first row, and none later, the whole-fund (European) one.

    Each tier is a running shortfall, which windows give without a loop; the tiers share one shuffle and one sort.
    """
    steps = deals
    left = F.col(proceeds)
    before = Window.partitionBy(*key).orderBy(*order)
    for name, owed in (("returned", F.col(capital)), ("preferred_paid", F.col(preferred)), ("catch_up", F.expr(f"(preferred_paid * {carry}) div (100 - {carry})"))):
        steps = steps.withColumns({"_owed": owed, "_left": left})
        steps = steps.withColumn("_sum", shortfall(F.col("_owed"), F.col("_left"), key, order))
        steps = steps.withColumn("_open", _floor("_sum", key, order))
        steps = steps.withColumn(name, F.coalesce(F.lag("_open").over(before), F.lit(0)) + F.col("_owed") - F.col("_open"))
        steps = steps.withColumn("_left", F.col("_left") - F.col(name))
        left = F.col("_left")
    share = F.expr(f"(_left * {carry}) div 100")
    out = steps.withColumn("carried", F.col("catch_up") + share)
    return out.withColumn("to_investors", F.col("returned") + F.col("preferred_paid") + F.col("_left") - share).drop("_owed", "_left", "_sum", "_open")


def projection(commitments: DataFrame, key: list[str], commitment: str, years: int) -> DataFrame:
    """The key, age, called and nav of each commitment at the end of each year, in whole cents.

    Each year calls a quarter of what is not yet called, and a tenth is added to what was held. The years are columns of a
    row before they are rows: as a recursion, the rows of all years count towards Spark's limit of rows.
    """
    steps = commitments.withColumns({"_called0": F.lit(0).cast("long"), "_nav0": F.lit(0).cast("long")})
    for k in range(1, years + 1):
        steps = steps.withColumn("_call", F.expr(f"({commitment} - _called{k - 1}) div 4"))
        steps = steps.withColumns({f"_called{k}": F.expr(f"_called{k - 1} + _call"), f"_nav{k}": F.expr(f"_nav{k - 1} + _nav{k - 1} div 10 + _call")})
    made = [F.struct(F.lit(k).alias("age"), F.col(f"_called{k}").alias("called"), F.col(f"_nav{k}").alias("nav")) for k in range(1, years + 1)]
    return steps.select(*key, F.inline(F.array(*made)))
