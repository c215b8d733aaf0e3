"""Walks over weighted ownership graphs, by rounds of joins until nothing is left to walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dealt, forget, written


def in_cycles(edges: DataFrame, rows: int = 0) -> DataFrame:
    """node: those on a cycle, or on a way from one cycle to another.

    Edges into nodes that own nothing go, and edges out of nodes that nothing owns, until none goes any more: a graph
    without cycles is empty after as many rounds as it has levels. ``rows``, if edges were counted, tells how they are dealt.
    """
    left = written(dealt(edges.select("owner", "owned"), rows, "owner", "owned").distinct(), "cycles")
    n, before = left.count(), -1
    while n and n != before:
        ends = dealt(left.select(F.col("owner").alias("owned")), n, "owned").distinct()
        starts = dealt(left.select(F.col("owned").alias("owner")), n, "owner").distinct()
        left = written(left.join(ends, "owned", "left_semi").join(starts, "owner", "left_semi").select("owner", "owned"), "cycles", instead=left)
        before, n = n, left.count()
    return left.select(F.col("owner").alias("node")).unionByName(left.select(F.col("owned").alias("node"))).distinct()


def look_through(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, leaf, weight: ownership multiplied along all paths and summed at leaves, which own nothing.

    ``edges`` has owner, owned and weight; ``roots`` has root. A path that meets itself ends; diamonds add up. Each round
    the weights of a root and node are summed before they go on, so what is held is a row a root and node, however many
    paths there are. Only inside cycles, where a path has to know where it was, is it a row of its own. Rounds go on until
    none is open, each written before the next. Edges are computed once, and large rounds are dealt by their rows.
    """
    edges = written(edges.select("owner", "owned", "weight"), "ownership")
    rows = edges.count()
    cycles = written(in_cycles(edges, rows), "in_cycles")
    parents = dealt(edges.select(F.col("owner").alias("node")), rows, "node").distinct().withColumn("more", F.lit(True))
    own = edges.join(cycles.select(F.col("node").alias("owned"), F.lit(True).alias("inside")), "owned", "left").select(F.col("owner").alias("node"), "owned", F.col("weight").alias("w"), "inside")
    own = dealt(own, rows, "node")
    first = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("weight")).join(cycles.withColumn("inside", F.lit(True)), "node", "left")
    none = F.array().cast(first.select(F.array("node")).schema[0].dataType)
    front = first.select("root", "node", "weight", F.when(F.col("inside"), F.array("node")).otherwise(none).alias("path"))
    leaves = []
    while not leaves or not front.isEmpty():
        step = front.join(own, "node").filter(~F.array_contains("path", F.col("owned")))
        step = step.select("root", F.col("owned").alias("node"), (F.col("weight") * F.col("w")).alias("weight"), F.when(F.col("inside"), F.concat("path", F.array("owned"))).otherwise(none).alias("path"))
        step = dealt(step, rows, "root", "node").groupBy("root", "node", "path").agg(F.sum("weight").alias("weight"))
        step = written(step.join(parents, "node", "left"), "paths", front if leaves else None)
        leaves.append(written(dealt(step.filter("more is null"), rows, "root", "node").groupBy("root", "node").agg(F.sum("weight").alias("weight")), "leaves"))
        front = step.filter("more").drop("more")
    forget(cycles, edges)
    whole = dealt(reduce(DataFrame.unionByName, leaves), rows, "root", "node")
    return whole.groupBy("root", F.col("node").alias("leaf")).agg(F.sum("weight").alias("weight"))
