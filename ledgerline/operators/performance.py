"""Performance and back-test measures of dated series, a key a row or a span a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawdown_spans(levels: DataFrame, key: list[str], day: str, level: str) -> DataFrame:
    """key, start, trough, recovery, depth and days of each time a level was under its peak.

    ``start`` is the last day at the peak, ``trough`` the first day of the least level, ``recovery`` the first day at the
    peak or above again (null while there is none), ``depth`` the least level over the peak, less one, and ``days`` the
    rows under it. One shuffle on the key and one sort.
    """
    order = Window.partitionBy(*key).orderBy(day)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = levels.withColumn("_peak", F.max(level).over(so_far)).withColumn("_under", F.col(level) < F.col("_peak"))
    marked = marked.withColumn("_at", F.last(F.when(~F.col("_under"), F.col(day)), ignorenulls=True).over(so_far)).withColumn("_next", F.lead(day).over(order))
    spans = marked.filter("_under").groupBy(*key, F.col("_at").alias("start")).agg(F.min(F.struct(F.col(level).alias("v"), F.col(day).alias("d"))).alias("low"), F.max("_peak").alias("peak"), F.max_by("_next", day).alias("recovery"), F.count("*").alias("days"))
    return spans.select(*key, "start", F.col("low.d").alias("trough"), "recovery", (F.col("low.v") / F.col("peak") - 1).alias("depth"), "days")


def ratio(over: Column, under: Column) -> Column:
    """Division as of doubles: by zero, infinite with the sign of what is divided, or not a number."""
    return F.when(under == 0, over * float("inf")).otherwise(over / under)


def correlation(a: Column, b: Column) -> Column:
    """Of pairs: an aggregate; not a number where either side stands still."""
    own, other = F.regr_syy(a, b), F.regr_sxx(a, b)
    return F.when((own == 0) | (other == 0), float("nan")).otherwise(F.regr_sxy(a, b) / F.sqrt(own) / F.sqrt(other))


def linked(rates: Column) -> Column:
    """The rate a period at which the given ones compound to the same: an aggregate; null where one loses all or more."""
    return F.when(F.min(rates) > -1, F.exp(F.avg(F.when(rates > -1, F.log1p(rates)))) - 1)


def capture(paired: DataFrame, key: list[str], own: str, market: str, parting: Column) -> DataFrame:
    """key, up, down: linked own rate over the market's, in periods where the condition holds and where it does not.

    Over a market that stood still, the rate is infinite or not a number.
    """
    side = lambda when, c: linked(F.when(when, F.col(c)))
    return paired.groupBy(*key).agg(*[ratio(side(w, own), side(w, market)).alias(n) for n, w in (("up", parting), ("down", ~parting))])


def calmar(levels: DataFrame, key: list[str], day: str, level: str, year: float = 365.0) -> DataFrame:
    """key, yearly, worst, calmar: compound yearly growth over the deepest fall from a peak; null without a fall."""
    deepest = drawdown_spans(levels, key, day, level).groupBy(*key).agg(F.min("depth").alias("worst"))
    ends = levels.groupBy(*key).agg(F.min_by(level, day).alias("a"), F.max_by(level, day).alias("z"), F.datediff(F.max(day), F.min(day)).alias("days")).filter("a > 0 and days > 0")
    yearly = F.pow(F.col("z") / F.col("a"), F.lit(year) / F.col("days")) - 1
    return ends.join(deepest, key, "left").select(*key, yearly.alias("yearly"), "worst", (yearly / -F.col("worst")).alias("calmar"))


def regression(paired: DataFrame, key: list[str], own: str, market: str) -> DataFrame:
    """key, n, beta, alpha, residual (its deviation), alpha_t and appraisal (alpha over residual) of own on market rates.

    Of three pairs or more. Over a market that stood still, or without a residual, they are infinite or not a number.
    """
    x, y = F.col(market), F.col(own)
    sums = paired.filter(x.isNotNull() & y.isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).filter("n > 2")
    left = F.greatest(F.col("vy") - ratio(F.col("c") * F.col("c"), F.col("vx")), F.lit(0.0)) * F.col("n") / (F.col("n") - 2)
    out = sums.withColumns({"beta": ratio(F.col("c"), F.col("vx")), "residual": F.sqrt(left)}).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    spread = F.sqrt((1 + ratio(F.col("mx") * F.col("mx"), F.col("vx"))) / F.col("n")) * F.col("residual")
    return out.select(*key, "n", "beta", "alpha", "residual", ratio(F.col("alpha"), spread).alias("alpha_t"), ratio(F.col("alpha"), F.col("residual")).alias("appraisal"))


def kupiec(days: DataFrame, key: list[str], breach: Column, rate: float) -> DataFrame:
    """key, n, breaches, statistic and rejected: whether breaches come at a rate other than the stated one (at 95 percent)."""
    counted = days.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(breach, 1)).alias("breaches"))
    x, n = F.col("breaches"), F.col("n")
    log_likelihood = lambda p: F.when(x > 0, x * F.log(p)).otherwise(0.0) + F.when(x < n, (n - x) * F.log(1 - p)).otherwise(0.0)
    statistic = -2 * (log_likelihood(F.lit(rate)) - log_likelihood(x / n))
    return counted.withColumn("statistic", statistic).withColumn("rejected", F.col("statistic") > 3.841459)


def attribution_tree(weights: DataFrame, levels: list[str], own_weight: str, own_rate: str, base_weight: str, base_rate: str) -> DataFrame:
    """Effects of each node of a tree of levels: allocation among its siblings, and what is left to its own children.

    Rows are leaves with weights and rates of both sides. A node's weight is the sum, its rate the weighted mean of its
    leaves. ``allocation`` of a node is its weight less what its parent's weight would give it by the base's shares, times
    its base rate beyond its parent's; ``selection`` is what its leaves earn beyond the base (leaves only). The
    effects of all nodes add up to the difference of the two sides' returns.
    """
    up, names = None, []
    frames = []
    for depth in range(len(levels) + 1):
        names = levels[:depth]
        node = weights.groupBy(*names).agg(F.sum(own_weight).alias("_w"), F.sum(F.col(own_weight) * F.col(own_rate)).alias("_wr"), F.sum(base_weight).alias("_b"), F.sum(F.col(base_weight) * F.col(base_rate)).alias("_br"))
        node = node.select(*names, "_w", "_b", F.when(F.col("_b") != 0, F.col("_br") / F.col("_b")).otherwise(0.0).alias("_rate"), F.when(F.col("_w") != 0, F.col("_wr") / F.col("_w")).otherwise(0.0).alias("_own"))
        if up is not None:
            parent = up.select(*names[:-1], F.col("_w").alias("_pw"), F.col("_b").alias("_pb"), F.col("_rate").alias("_prate"))
            met = node.join(parent, names[:-1]) if names[:-1] else node.crossJoin(F.broadcast(parent))  # the root is one row
            share = F.col("_w") - F.when(F.col("_pb") != 0, F.col("_pw") * F.col("_b") / F.col("_pb")).otherwise(0.0)
            leaf = F.col("_w") * (F.col("_own") - F.col("_rate")) if depth == len(levels) else F.lit(0.0)
            frames.append(met.select(F.lit(depth).alias("depth"), *[F.col(c).cast("string") for c in names], *[F.lit(None).cast("string").alias(c) for c in levels[depth:]], (share * (F.col("_rate") - F.col("_prate"))).alias("allocation"), leaf.alias("selection")))
        up = node
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
