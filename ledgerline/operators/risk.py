"""Portfolio risk by factors: covariance, parametric and simulated value at risk, expected exposure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Factors of a block of the covariance; factors that a simulation takes at most; portfolios and scenarios of a tile.
BLOCK, FACTORS, PORTFOLIOS, SCENARIOS = 64, 2000, 256, 1024


def covariance(returns: DataFrame, factor: str, day: str, value: str, block: int = BLOCK) -> DataFrame:
    """i, j, cov: the sample covariance of each two factors over the days that both have, both orders and i = j.

    Factors are numbered and dealt into blocks; a day's values of a block are one row, and each two blocks of a day meet
    once, so what is summed is a matrix of sums for each pair of blocks: days times pairs of blocks, not of factors. A
    factor and day with several rows counts with their sum.
    """
    daily = returns.filter(F.col(value).isNotNull()).groupBy(F.col(factor).alias("f"), F.col(day).alias("d")).agg(F.sum(value).cast("double").alias("x"))
    daily = written(daily, "daily")
    # numbers by a hash, so that no sort of all factors is needed: a block has about ``block`` of them
    blocks = max(1, -(-daily.select("f").distinct().count() // block))
    packed = daily.withColumn("b", F.pmod(F.xxhash64("f"), F.lit(blocks)).cast("int")).groupBy("d", "b").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("v"))
    left, right = packed.select("d", F.col("b").alias("b1"), F.col("v").alias("v1")), packed.select("d", F.col("b").alias("b2"), F.col("v").alias("v2"))
    met = left.join(right, "d").filter("b1 <= b2")
    kind = daily.schema["f"].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for v1, v2 in zip(batch["v1"], batch["v2"], strict=True):
                a, b = ([e["f"] for e in v1], np.array([e["x"] for e in v1])), ([e["f"] for e in v2], np.array([e["x"] for e in v2]))
                n, m = len(a[1]), len(b[1])
                x, y = np.repeat(a[1], m), np.tile(b[1], n)
                yield pd.DataFrame({"i": np.repeat(np.array(a[0], object), m), "j": np.tile(np.array(b[0], object), n), "n": 1, "x": x, "y": y, "xy": x * y})

    each = met.mapInPandas(sums, f"i {kind}, j {kind}, n long, x double, y double, xy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])
    half = each.filter("n > 1").select("i", "j", ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)).alias("cov"))
    half = written(half, "covariance")
    # blocks that met in one order only give the other one here
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "cov")).groupBy("i", "j").agg(F.max("cov").alias("cov"))


def sigma(exposures: DataFrame, cov: DataFrame, portfolio: str, factor: str, amount: str) -> DataFrame:
    """portfolio, sigma: the deviation of a portfolio's result, by its exposures and the covariances of their factors."""
    own = exposures.groupBy(portfolio, F.col(factor).alias("i")).agg(F.sum(amount).cast("double").alias("w"))
    spread = own.join(cov, "i").groupBy(portfolio, "j").agg(F.sum(F.col("w") * F.col("cov")).alias("c"))
    return spread.join(own.withColumnRenamed("i", "j"), [portfolio, "j"]).groupBy(portfolio).agg(F.sqrt(F.greatest(F.sum(F.col("w") * F.col("c")), F.lit(0.0))).alias("sigma"))


def root(cov: pd.DataFrame) -> tuple[list, np.ndarray]:
    """Factors in order and a matrix whose product with its transpose is their covariance, which may lack full rank."""
    names = sorted(set(cov["i"]))
    if len(names) > FACTORS:
        raise ValueError(f"{len(names)} factors; a simulation takes {FACTORS} at most")
    place = {f: k for k, f in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    c[cov["i"].map(place), cov["j"].map(place)] = cov["cov"]
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    return names, vectors * np.sqrt(np.clip(values, 0, None))


def draws(seed: int, block: int, n: int, factors: int) -> np.ndarray:
    """Standard normal numbers of a block of scenarios: the same wherever and whenever they are drawn."""
    return np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, block])).standard_normal((n, factors))


def simulate(exposures: DataFrame, cov: DataFrame, portfolio: str, factor: str, amount: str, scenarios: int = 8192, level: float = 0.99, seed: int = 1) -> DataFrame:
    """portfolio, var, es: value at risk and expected shortfall over correlated scenarios, both as losses.

    The covariance of at most ``FACTORS`` factors goes to the tasks as its root. A task takes portfolios in tiles, which
    meet the scenarios block by block, drawn anew from their numbers, so nothing but exposures is shuffled; a portfolio's
    results are ``scenarios`` numbers, of which quantiles are exact. The deviation of a quantile by chance falls with the
    root of the scenarios. Factors without a covariance don't move.
    """
    names, half = root(cov.toPandas())  # factors squared, which is bounded
    place = {f: k for k, f in enumerate(names)}
    kind = exposures.schema[portfolio].dataType.simpleString()
    own = exposures.groupBy(portfolio, F.col(factor).alias("f")).agg(F.sum(amount).cast("double").alias("w"))
    packed = own.groupBy(portfolio).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PORTFOLIOS):
                part = batch.iloc[at : at + PORTFOLIOS]
                w = np.zeros((len(part), len(names)))
                for k, v in enumerate(part["v"]):
                    for e in v:
                        if e["f"] in place:
                            w[k, place[e["f"]]] += e["w"]
                result = np.concatenate([draws(seed, b, min(SCENARIOS, scenarios - b * SCENARIOS), len(names)) @ (w @ half).T for b in range(-(-scenarios // SCENARIOS))])
                losses = np.sort(-result, axis=0)
                tail = losses[int(np.ceil(level * scenarios)) - 1 :]
                yield pd.DataFrame({portfolio: part[portfolio].to_numpy(), "var": tail[0], "es": tail.mean(axis=0)})

    return packed.mapInPandas(run, f"{portfolio} {kind}, var double, es double")


def expected_exposure(paths: DataFrame, key: str, step: str, mean: str, deviation: str, scenarios: int = 4096, seed: int = 1) -> DataFrame:
    """Adds ``exposure``, the mean over scenarios of what is positive, and ``peak``, its 95th percentile, of each step of a key.

    A key's value moves from step to step by ``mean`` and a normal change of ``deviation``; a scenario is one path, drawn
    from the number of the step, and steps of a key (years of a counterparty, few) are in one row.
    """
    kind = paths.schema[key].dataType.simpleString()
    packed = paths.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(step).cast("long").alias("k"), F.col(mean).cast("double").alias("m"), F.col(deviation).cast("double").alias("s")))).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, v in zip(batch[key], batch["v"], strict=True):
                value, out = np.zeros(scenarios), []
                for e in v:
                    value = value + e["m"] + e["s"] * draws(seed, e["k"], scenarios, 1)[:, 0]
                    held = np.maximum(value, 0)
                    out.append((name, e["k"], held.mean(), np.quantile(held, 0.95)))
                yield pd.DataFrame(out, columns=[key, step, "exposure", "peak"])

    return packed.mapInPandas(run, f"{key} {kind}, {step} long, exposure double, peak double")
