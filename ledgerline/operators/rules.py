"""Integrity rules: each is a frame of defects; a report is the union of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of a range whose gaps are found at once; the ranges' edges, one row each, meet in one more window.
RANGE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A rule's name and severity, and the frame of (subject, message) rows that break it."""

    name: str
    severity: str
    defects: Callable[[dict[str, DataFrame]], DataFrame]


def report(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """rule, severity, subject, message of all defects, in one plan."""
    frames = [r.defects(tables).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col("subject").cast("string").alias("subject"), "message") for r in rules]
    return reduce(DataFrame.unionByName, frames)


def unresolved(table: str, key: str, target: str, target_key: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """References of a table that have no row in their target."""
    return lambda t: t[table].filter(F.col(key).isNotNull()).join(t[target].select(F.col(target_key).alias(key)).distinct(), key, "left_anti").select(F.col(key).alias("subject"), F.lit(f"{table}.{key} has no {target}").alias("message"))


def not_unique(table: str, key: list[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].groupBy(*key).count().filter("count > 1").select(F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("subject"), F.lit(f"{table} repeats {'/'.join(key)}").alias("message"))


def violates(table: str, subject: str, condition: Column | str, message: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: t[table].filter(condition).select(F.col(subject).alias("subject"), F.lit(message).alias("message"))


def gaps(table: str, number: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Numbers that are missing between the least and the largest."""

    def run(t: dict[str, DataFrame]) -> DataFrame:
        # only gaps are spread: each from a number to the next one there is, within a range of numbers and to the next range
        own = t[table].select(F.col(number).cast("long").alias("n")).distinct().withColumn("part", F.expr(f"n div {RANGE}"))
        inside = own.withColumn("next", F.lead("n").over(Window.partitionBy("part").orderBy("n")))
        edges = own.groupBy("part").agg(F.min("n").alias("first"), F.max("n").alias("last"))
        across = edges.select("last", F.lead("first").over(Window.orderBy("part")).alias("next"))
        spans = inside.select("n", "next").unionByName(across.select(F.col("last").alias("n"), "next")).filter("next > n + 1")
        return spans.select(F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1)).alias("subject")).select("subject", F.lit(f"{table}.{number} is missing").alias("message"))

    return run
