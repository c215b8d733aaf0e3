"""Money-weighted returns and metric formulas on columns."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Days of flows in a bucket whose rates are found together.
ROWS = 100_000


def irr(flows: DataFrame, key: list[str], day: str, amount: str, low: float = -0.9, high: float = 10.0, steps: int = 60, buckets: int | None = None) -> DataFrame:
    """The yearly rate at which dated flows are worth nothing, by bisection; null without a change of sign.

    ``day`` is a number of days. Flows of one key and day are summed before they are dealt, so a key has a row a day at
    most, however many flows it has; keys are dealt in buckets of about ``ROWS`` rows, whose rates are found together.
    """
    daily = flows.groupBy(*key, F.col(day).alias("_day")).agg(F.sum(F.col(amount)).cast("double").alias("_amount"))
    if not buckets:
        daily = written(daily, "flows")
    n = buckets or max(1, -(-daily.count() // ROWS))
    dealt = daily.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(n)))
    kinds = ", ".join(f"{c} {flows.schema[c].dataType.simpleString()}" for c in key)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*key, "_day"], ignore_index=True)
        group = rows.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
        first = np.flatnonzero(np.diff(group, prepend=-1))
        years, value = rows["_day"].to_numpy() / 365.25, rows["_amount"].to_numpy()
        npv = lambda rate: np.add.reduceat(value / (1.0 + rate[group]) ** years, first)
        a, z = np.full(len(first), low), np.full(len(first), high)
        at_low = np.sign(npv(a))
        ok = at_low * np.sign(npv(z)) < 0
        for _ in range(steps):
            m = (a + z) / 2
            right = npv(m) * at_low > 0
            a, z = np.where(right, m, a), np.where(right, z, m)
        out = rows.loc[first, key].copy()
        out["irr"] = np.where(ok, (a + z) / 2, np.nan)
        return out.astype({"irr": "float64"})

    found = dealt.groupBy("_bucket").applyInPandas(solve, f"{kinds}, irr double")
    return found.withColumn("irr", F.nullif(F.col("irr"), F.lit(float("nan"))))


def compile_metric(spec: str | dict) -> Column:
    """A column from a formula: {"op": "add" | "sub" | "mul" | "div" | "sum" | "avg" | "max", "args": [...]}, {"col": name} or {"value": number}."""
    node = json.loads(spec) if isinstance(spec, str) else spec
    if "col" in node:
        return F.col(node["col"])
    if "value" in node:
        return F.lit(node["value"])
    args = [None if isinstance(a, dict) and a.get("op") in ("gt", "ge", "lt", "le", "eq") else compile_metric(a) for a in node["args"]]
    if node["op"] == "case":  # pairs of a condition and a value, and one more value
        conditions = [(compile_condition(c), v) for c, v in zip(node["args"][:-1:2], args[1:-1:2], strict=True)]
        return F.coalesce(*[F.when(c, v) for c, v in conditions], args[-1])
    binary = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b)}
    single = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}
    if node["op"] in binary:
        return binary[node["op"]](*args)
    if node["op"] in single:
        return single[node["op"]](*args)
    raise ValueError(f"unknown operation {node['op']}")


def compile_condition(node: dict) -> Column:
    """{"op": "gt" | "ge" | "lt" | "le" | "eq", "args": [a, b]}."""
    a, b = map(compile_metric, node["args"])
    return {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b}[node["op"]]


def evaluate_terms(frame: DataFrame, terms: list[tuple[str, str, str]], key: str, name: str) -> DataFrame:
    """Adds the value of each row's term: ``terms`` are (key value, FIXED or COMPUTED, a rate or a formula).

    Each distinct term is compiled once into the plan, so terms are as many as their versions, not as rows.
    """
    value = {"FIXED": lambda spec: F.lit(float(spec)), "COMPUTED": compile_metric}
    return frame.withColumn(name, F.coalesce(*[F.when(F.col(key) == k, value[kind](spec)) for k, kind, spec in terms]))


def bootstrap(rates: DataFrame, curve: list[str], maturity: str, rate: str) -> DataFrame:
    """curve, maturity, discount and zero rate from par rates of maturities 1, 2, ... years, each from those before it.

    A curve's rates are an array (as long as its maturities), folded once. It ends before the first maturity without a rate.
    """
    sorted_rates = F.array_sort(F.collect_list(F.struct(F.col(maturity).alias("m"), F.col(rate).cast("double").alias("r"))))
    arrays = rates.groupBy(*curve).agg(F.transform(F.filter(sorted_rates, lambda x, i: x["m"] == i + 1), lambda x: x["r"]).alias("_r"))
    fold = F.aggregate("_r", F.struct(F.lit(0.0).alias("annuity"), F.array().cast("array<double>").alias("d")), lambda a, r: F.struct((a["annuity"] + (1 - r * a["annuity"]) / (1 + r)).alias("annuity"), F.concat(a["d"], F.array((1 - r * a["annuity"]) / (1 + r))).alias("d")), lambda a: a["d"])
    placed = arrays.select(*curve, F.posexplode(fold).alias("k", "discount"))
    return placed.select(*curve, (F.col("k") + 1).alias(maturity), "discount", (F.pow(F.col("discount"), -1.0 / (F.col("k") + 1)) - 1).alias("zero"))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function by a rational approximation (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / (2 * np.pi) ** 0.5 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black(forward: Column, strike: Column, vol: Column, years: Column, discount: Column, call: bool = True) -> Column:
    """The value of a European option on a forward."""
    sd = vol * F.sqrt(years)
    d1 = F.log(forward / strike) / sd + sd / 2
    sign = 1 if call else -1
    return discount * sign * (forward * normal_cdf(sign * d1) - strike * normal_cdf(sign * (d1 - sd)))


def performance_fees(navs: DataFrame, key: list[str], period: str, nav: str, rate_percent: int = 20, hurdle_percent: int = 1) -> DataFrame:
    """key, fees, mark, crystallised: fees on what a period's end has above both the high-water mark and the hurdle.

    ``navs`` has one gross value (whole units) a period end. A fee is taken at the period's end, lowers the value from
    then on, and sets the mark to what is left. A key's periods are one array, folded once.
    """
    arrays = navs.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(nav).cast("long").alias("v")))), lambda x: x["v"]).alias("_v"))
    step = f"""(a, v) -> named_struct('fees', a.fees + greatest(0L, v - a.fees - greatest(a.mark, a.base + (a.base * {hurdle_percent}) div 100)) * {rate_percent} div 100,
        'mark', greatest(a.mark, v - a.fees - greatest(0L, v - a.fees - greatest(a.mark, a.base + (a.base * {hurdle_percent}) div 100)) * {rate_percent} div 100),
        'base', v - a.fees - greatest(0L, v - a.fees - greatest(a.mark, a.base + (a.base * {hurdle_percent}) div 100)) * {rate_percent} div 100,
        'n', a.n + if(v - a.fees > greatest(a.mark, a.base + (a.base * {hurdle_percent}) div 100), 1L, 0L))"""
    fold = F.expr(f"aggregate(slice(_v, 2, greatest(size(_v) - 1, 0)), named_struct('fees', 0L, 'mark', _v[0], 'base', _v[0], 'n', 0L), {step})")
    return arrays.select(*key, fold.alias("x")).select(*key, "x.fees", "x.mark", F.col("x.n").alias("crystallised"))


def least_variance(returns: DataFrame, group: str, asset: str, period: str, value: str) -> DataFrame:
    """group, asset, weight: the long-only weights of least variance, which sum to one.

    Moments of each pair of a group's assets are sums over common periods; a group's matrix (assets squared) is solved at
    once: weights below zero are set to zero one after another, the most negative first, until none is left.
    """
    a, b = returns.select(group, period, F.col(asset).alias("i"), F.col(value).alias("x")), returns.select(group, period, F.col(asset).alias("j"), F.col(value).alias("y"))
    cov = a.join(b, [group, period]).groupBy(group, "i", "j").agg(F.covar_samp("x", "y").alias("c"))
    kind = f"{group} {returns.schema[group].dataType.simpleString()}, {asset} {returns.schema[asset].dataType.simpleString()}, weight double"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="i", columns="j", values="c").sort_index().sort_index(axis=1)
        names, c = list(matrix.index), np.nan_to_num(matrix.to_numpy()) + 1e-12 * np.eye(len(matrix))
        held = list(range(len(names)))
        while True:
            w = np.linalg.solve(c[np.ix_(held, held)], np.ones(len(held)))
            w = w / w.sum()
            if (w >= -1e-12).all() or len(held) == 1:
                break
            held.pop(int(w.argmin()))
        weight = np.zeros(len(names))
        weight[held] = np.maximum(w, 0) / np.maximum(w, 0).sum()
        return pd.DataFrame({group: rows[group].iloc[0], asset: names, "weight": weight})

    return cov.groupBy(group).applyInPandas(solve, kind)
