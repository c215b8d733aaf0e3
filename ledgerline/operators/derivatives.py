"""Derivatives: implied volatility and its surface, resets and leg cash, compression of notionals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lots import relieve
from .temporal import as_of_join


def _cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function by the approximation that ``returns.normal_cdf`` has."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def solve_vol(price: np.ndarray, f: np.ndarray, k: np.ndarray, t: np.ndarray, d: np.ndarray, call: np.ndarray, low: float = 1e-4, high: float = 5.0, steps: int = 60) -> np.ndarray:
    """The volatilities of all options at once; NaN where none between ``low`` and ``high`` gives the price.

    Newton steps, each held inside the bracket that the steps before have left (half of it where one would leave it).
    """
    root, sign = np.sqrt(t), np.where(call, 1.0, -1.0)

    def at(vol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1 = np.log(f / k) / (vol * root) + vol * root / 2
        return sign * d * (f * _cdf(sign * d1) - k * _cdf(sign * (d1 - vol * root))), f * d * root * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi)

    a, z, x = np.full(len(price), low), np.full(len(price), high), np.full(len(price), 0.3)
    inside = (at(a)[0] <= price) & (price <= at(z)[0])
    for _ in range(steps):
        value, vega = at(x)
        off = value - price
        a, z = np.where(off < 0, x, a), np.where(off < 0, z, x)
        newton = x - off / np.maximum(vega, 1e-300)
        x = np.where((newton > a) & (newton < z), newton, (a + z) / 2)
    return np.where(inside, x, np.nan)


@F.pandas_udf(T.DoubleType())
def _implied(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for columns in parts:
        *numbers, call = [c.to_numpy() for c in columns]
        with np.errstate(all="ignore"):
            found = solve_vol(*[x.astype(float) for x in numbers], call.astype(bool))
        yield pd.Series(found)


def implied_vol(price: Column, forward: Column, strike: Column, years: Column, discount: Column, call: bool = True) -> Column:
    """The volatility at which the closed form gives the price, for a batch of trades at once; null where none does.

    An Arrow batch is solved together: the steps as a fold of built-in functions took some 30 ms a row.
    """
    found = _implied(*[c.cast("double") for c in (price, forward, strike, years, discount)], F.lit(call))
    return F.when(~F.isnan(found), found)


def surface(quotes: DataFrame, under: str, expiry: str, moneyness: str, vol: str) -> DataFrame:
    """under, expiry, a, b, c, n, error: total variance a + b k + c k * k of each expiry by least squares, k the log moneyness.

    Sums of powers are all that is gathered of an expiry. With fewer than three different strikes there is no fit.
    """
    k, w = F.col(moneyness), F.col(vol) * F.col(vol) * F.col(expiry)
    powers = [F.sum(F.pow(k, F.lit(p))).alias(f"s{p}") for p in range(5)] + [F.sum(F.pow(k, F.lit(p)) * w).alias(f"t{p}") for p in range(3)] + [F.sum(w * w).alias("ww"), F.count_distinct(k).alias("strikes")]
    sums = quotes.filter(F.col(vol).isNotNull()).groupBy(under, expiry).agg(F.count("*").alias("n"), *powers).filter("strikes >= 3")
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    rows = ["s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"]
    put = lambda column: [f"t{j // 3}" if j % 3 == column else x for j, x in enumerate(rows)]
    fitted = sums.selectExpr(under, expiry, "n", *[f"{det(put(c))} / {det(rows)} as {name}" for c, name in enumerate("abc")], "s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "ww")
    error = "sqrt(greatest(0, (ww - 2 * (a * t0 + b * t1 + c * t2) + a * a * s0 + 2 * a * b * s1 + (b * b + 2 * a * c) * s2 + 2 * b * c * s3 + c * c * s4) / n))"
    return fitted.selectExpr(under, expiry, "a", "b", "c", "n", f"{error} as error")


def arbitrage(fitted: DataFrame, under: str, expiry: str, grid: list[float]) -> DataFrame:
    """under, expiry, k, kind of each violation on a grid of log moneyness.

    ``calendar``: total variance is less than at the expiry before. ``butterfly``: the density that the fit implies is
    below zero (or the variance is not above it).
    """
    points = fitted.select(under, expiry, "a", "b", "c", F.explode(F.array(*map(F.lit, grid))).alias("k"))
    at = points.withColumns({"w": F.expr("a + b * k + c * k * k"), "d": F.expr("b + 2 * c * k")})
    before = F.lag("w").over(Window.partitionBy(under, "k").orderBy(expiry))
    density = F.expr("power(1 - k * d / (2 * w), 2) - d * d / 4 * (1 / w + 0.25D) + c")
    kinds = at.withColumn("before", before).select(under, expiry, "k", F.explode(F.array(F.when(F.col("w") < F.col("before"), "calendar"), F.when((F.col("w") <= 0) | (density < 0), "butterfly"))).alias("kind"))
    return kinds.filter("kind is not null")


def leg_cash(periods: DataFrame, fixings: DataFrame, index: list[str], start: str, end: str, notional: str, spread: str, fixed_on: str, rate: str, year: int = 360) -> DataFrame:
    """Adds to each period the rate fixed last before it starts, its day, and the cash of its leg.

    Rates and the spread are in basis points, notional and cash in cents, rounded toward zero. A period without a fixing
    has none. An as-of merge, so no pairs of periods and fixings are formed.
    """
    met = as_of_join(periods, fixings, index, start, fixed_on, [rate], strict=True)
    return met.withColumn("cash", F.expr(f"(`{notional}` * (`{rate}` + `{spread}`) * datediff(`{end}`, `{start}`)) div {10_000 * year}L"))


def compress(trades: DataFrame, terms: list[str], payer: str, receiver: str, notional: str) -> DataFrame:
    """terms, payer, receiver, notional: fewer trades that leave every party's net as it was.

    A cycle of trades adds nothing to any net, so netting takes all cycles out, and chains become one trade. What parties
    pay in net meets what others receive in net, the cumulative amounts of both sides laid upon each other, which is a
    merge: at most one trade fewer than parties, and a gross that is the least which the nets allow. A trade with oneself
    is none.
    """
    legs = trades.select(*terms, F.explode(F.array(F.struct(F.col(payer).alias("party"), (-F.col(notional)).alias("q")), F.struct(F.col(receiver).alias("party"), F.col(notional).alias("q")))).alias("l"))
    net = legs.groupBy(*terms, F.col("l.party").alias("party")).agg(F.sum("l.q").alias("q"))
    pays = net.filter("q < 0").select(*terms, F.col("party").alias("payer"), (-F.col("q")).alias("q"))
    gets = net.filter("q > 0").select(*terms, F.col("party").alias("receiver"), "q")
    met = relieve(pays, gets, terms, "q", ["payer"], ["receiver"])
    return met.select(*terms, F.col("lot_payer").alias("payer"), F.col("sale_receiver").alias("receiver"), F.col("matched").alias("notional"))
