"""Probabilistic record linkage: blocked pairs, agreement patterns, weights by expectation maximisation, a review band."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


@dataclass(frozen=True)
class Weights:
    """What was fitted: by field, how often true and false pairs agree; the part of pairs that are true; bits of weight."""

    m: np.ndarray
    u: np.ndarray
    part: float

    @property
    def agree(self) -> np.ndarray:
        return np.log2(self.m / self.u)

    @property
    def differ(self) -> np.ndarray:
        return np.log2((1 - self.m) / (1 - self.u))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, start: float = 0.9) -> Weights:
    """Expectation maximisation over the distinct patterns of agreement (rows of 0 and 1) and their numbers of pairs."""
    x, n = patterns.astype(float), counts.astype(float)
    m, u, part = np.full(x.shape[1], start), np.full(x.shape[1], 1 - start), 0.1
    for _ in range(rounds):
        true = part * np.prod(np.where(x == 1, m, 1 - m), axis=1)
        false = (1 - part) * np.prod(np.where(x == 1, u, 1 - u), axis=1)
        share = true / (true + false)
        part = float((share * n).sum() / n.sum())
        held = lambda w: np.clip((w[:, None] * x).sum(axis=0) / max(w.sum(), 1e-12), 1e-6, 1 - 1e-6)
        m, u = held(share * n), held((1 - share) * n)
        part = min(max(part, 1e-9), 1 - 1e-9)
    return Weights(m, u, part)


def keyed(left: DataFrame, right: DataFrame, blocks: list[tuple[list[Column], list[Column]]], most: int = 1000) -> list[DataFrame]:
    """Both sides with ``_k0``, ``_k1`` ...: the key of each row's block, by each list of expressions.

    A block is given by a list of expressions of each side: the first is its key, and the rest refine it. A block of more
    than ``most`` rows of a side is split by the next expression, and so on, so no block is cut; what is still larger after
    the last expression is equal in all of them, and stays whole. A key that is null gives no block.
    """
    sides = [left, right]
    for j, both in enumerate(blocks):
        key = f"_k{j}"
        sides = [s.withColumn("_e", F.array(*[e.cast("string") for e in own])).withColumn(key, F.when(F.col("_e")[0].isNotNull(), F.slice("_e", 1, 1))) for s, own in zip(sides, both, strict=True)]
        for k in range(1, len(both[0])):
            sizes = [s.filter(F.size(key) == k).groupBy(key).agg(F.count("*").alias("n")) for s in sides]
            large = written(sizes[0].unionByName(sizes[1]).groupBy(key).agg(F.max("n").alias("n")).filter(F.col("n") > most).select(key, F.lit(True).alias("_large")), "large")
            if large.isEmpty():
                break
            finer = F.when(F.col("_large"), F.concat(key, F.array(F.coalesce(F.col("_e")[k], F.lit(""))))).otherwise(F.col(key))
            sides = [s.join(large, key, "left").withColumn(key, finer).drop("_large") for s in sides]
        sides = [s.drop("_e") for s in sides]
    return sides


def in_blocks(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Pairs of rows that share one of ``n`` blocks, with the columns of both, each pair at the first block that it shares.

    Only rows are shuffled, once a block: whether two rows have met before is told by their keys, so pairs need no other
    exchange to be each once.
    """
    found = None
    for j in range(n):
        met = left.filter(F.col(f"_k{j}").isNotNull()).join(right.filter(F.col(f"_k{j}").isNotNull()).withColumnsRenamed({f"_k{i}": f"_m{i}" for i in range(n)}), F.col(f"_k{j}") == F.col(f"_m{j}"))
        for i in range(j):
            met = met.filter(~F.coalesce(F.col(f"_k{i}") == F.col(f"_m{i}"), F.lit(False)))
        met = met.drop(*[f"_{c}{i}" for c in "km" for i in range(n)])
        found = met if found is None else found.unionByName(met)
    return found


def candidates(left: DataFrame, right: DataFrame, blocks: list[list[Column]], left_id: str, right_id: str, most: int = 1000) -> DataFrame:
    """Pairs of ids that share a block (see ``keyed``; the expressions are the same for both sides), each once.

    Pairs that only a split separates are for another block of the list to find.
    """
    sides = keyed(left, right, [(b, b) for b in blocks], most)
    own = [s.select(F.col(i).alias(f"{side}_id"), *[f"_k{j}" for j in range(len(blocks))]) for s, i, side in zip(sides, (left_id, right_id), ("left", "right"), strict=True)]
    return in_blocks(*own, len(blocks)).select("left_id", "right_id").distinct()


def link_blocks(left: DataFrame, right: DataFrame, fields: dict[str, Column], blocks: list[tuple[list[Column], list[Column]]], left_id: str, right_id: str, lower: float, upper: float, most: int = 1000) -> tuple[DataFrame, Weights]:
    """As ``link``, of the pairs that share a block (see ``keyed``); sides have a row an id, and columns of other names.

    Pairs are formed twice, for the fit and for the weights, and never shuffled: what is written are those of ``lower``
    bits and more.
    """
    sides = [written(s.withColumnRenamed(i, f"{side}_id"), "keyed") for s, i, side in zip(keyed(left, right, blocks, most), (left_id, right_id), ("left", "right"), strict=True)]
    return judged(in_blocks(*sides, len(blocks)), fields, lower, upper)


def link(left: DataFrame, right: DataFrame, fields: dict[str, Column], pairs: DataFrame, left_id: str, right_id: str, lower: float, upper: float) -> tuple[DataFrame, Weights]:
    """left_id, right_id, weight and state of candidate pairs, and the weights.

    ``fields`` gives, by name, when a pair agrees: a condition over columns of ``left`` and ``right``, whose names differ.
    A weight is the sum of the fields' bits. Pairs of ``upper`` bits and more, of which no side has a better one, are
    ``match``; pairs of ``lower`` bits and more are ``review``, the queue for a steward, as are pairs with a tie; others
    are ``other``. Distinct patterns, two to the number of fields at most, are what the fit gets.
    """
    met = pairs.join(left.withColumnRenamed(left_id, "left_id"), "left_id").join(right.withColumnRenamed(right_id, "right_id"), "right_id")
    return judged(met, fields, lower, upper)


def judged(met: DataFrame, fields: dict[str, Column], lower: float, upper: float) -> tuple[DataFrame, Weights]:
    """What ``link`` gives, of pairs that have the columns of both sides."""
    agreed = met.select("left_id", "right_id", *[F.coalesce(c, F.lit(False)).cast("int").alias(f"_{k}") for k, c in enumerate(fields.values())])
    own = [f"_{k}" for k in range(len(fields))]
    rows = agreed.groupBy(*own).agg(F.count("*").alias("n")).orderBy(*own).collect()
    if not rows:
        return agreed.select("left_id", "right_id", F.lit(0.0).alias("weight"), F.lit("other").alias("state")), Weights(np.full(len(own), 0.9), np.full(len(own), 0.1), 0.1)
    weights = fit(np.array([[r[c] for c in own] for r in rows]), np.array([r["n"] for r in rows]))
    bits = sum(F.when(F.col(c) == 1, float(a)).otherwise(float(d)) for c, a, d in zip(own, weights.agree, weights.differ, strict=True))
    scored = agreed.select("left_id", "right_id", F.round(bits, 9).alias("weight"))
    kept = written(scored.filter(F.col("weight") >= min(lower, upper)), "scored")
    # a pair of ``upper`` bits is the best of its sides, or not, by pairs of as many bits alone
    rank = lambda side: F.rank().over(Window.partitionBy(side).orderBy(F.desc("weight")))
    ties = lambda side: F.count("*").over(Window.partitionBy(side, "weight"))
    ranked = kept.filter(F.col("weight") >= upper).withColumns({"_l": rank("left_id"), "_tl": ties("left_id"), "_r": rank("right_id"), "_tr": ties("right_id")})
    best = (F.col("_l") == 1) & (F.col("_r") == 1) & (F.col("_tl") == 1) & (F.col("_tr") == 1)
    queued = F.when(F.col("weight") >= lower, "review").otherwise("other")
    parts = [ranked.withColumn("state", F.when(best, "match").otherwise(queued)), kept.filter(F.col("weight") < upper).withColumn("state", queued), scored.filter(F.col("weight") < min(lower, upper)).withColumn("state", F.lit("other"))]
    out = reduce(DataFrame.unionByName, [p.select("left_id", "right_id", "weight", "state") for p in parts])
    return out, weights
