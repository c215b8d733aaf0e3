"""Connected components of a table of links by alternating large-star and small-star steps, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owning, written


def _links(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node with a lesser one has just that one and no greater one: all links lead to a least node."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for all nodes of links a, b (long).

    Rows are two numbers each; a hub's rows meet its least neighbour in one sort-merge join, whose skewed partitions
    adaptive execution splits (links of ``op3_jaccard`` have no hub of more than a thousandth of its rows to start with).
    A round's table goes when the next one stands.
    """
    edges = written(_links(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "links")
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(_links(small), "links", edges)
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return owning(named.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), edges)
