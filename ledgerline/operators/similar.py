"""Pairs of similar vectors by random projections, each candidate checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, written

#: Tables of projections; bits of a bucket's key at first and at last; rows of a bucket before it is split.
TABLES, BITS, MOST_BITS, FULL = 24, 8, 64, 512
PAIRS = "a long, b long, cosine double"


def _planes(dim: int, tables: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).standard_normal((dim, tables * MOST_BITS))


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    x = values.flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, bits: int = BITS, full: int = FULL, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, cosine) of different directions whose cosine is ``least`` or more, and members (a, member) of equal ones.

    Vectors of one direction to seven digits are one, told by their least key, so copies make no pairs. The others get, in
    each table, a key of the sides of random planes on which they lie. A bucket of more than ``full`` vectors is split by
    twice the bits, again and again; two vectors at a small angle stay together under many bits, so what a split parts are
    pairs that other tables find. What is still together under ``MOST_BITS`` is compared with the least key of its bucket,
    so no large bucket's pairs are all made: its vectors, nearly of one direction, are linked through that one. Every cosine that is told is exact; a
    pair at the threshold itself may be missed, with a chance that ``recall`` states. Vectors that are null, of length 0,
    or hold null, NaN or infinity have no direction; vectors of different widths are not alike.
    """
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    direction = F.transform("v", lambda x: F.round(x / norm, 7) + F.lit(0.0))
    grouped = own.withColumn("d", F.xxhash64(direction, F.size("v")))
    grouped = written(grouped.withColumn("_d2", F.xxhash64(F.lit(1), direction)), "directions")
    heads = grouped.groupBy("d", "_d2").agg(F.min("id").alias("a"))
    members = grouped.select("id", "d", "_d2").join(heads, ["d", "_d2"]).filter("a <> id").select("a", F.col("id").alias("member"))
    rows = written(grouped.groupBy("d", "_d2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).select("id", "v", F.size("v").alias("dim")), "heads")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims, lists = b.column("dim").to_numpy(), b.column("v")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = _planes(dim, tables, seed)
                x = _unit(lists.take(pa.array(at)), dim)
                bit = (x @ planes[dim] > 0).reshape(len(at), tables, MOST_BITS)
                words = np.packbits(bit, axis=2).view(">u8").reshape(len(at), tables).astype("<i8")
                yield pa.record_batch([b.column("id").take(pa.array(at)), pa.ListArray.from_arrays(np.arange(0, words.size + 1, tables, dtype=np.int32), pa.array(words.ravel())), b.column("dim").take(pa.array(at))], ["id", "words", "dim"])

    signed = rows.mapInArrow(sign, "id long, words array<bigint>, dim int").select("id", "dim", F.posexplode("words").alias("t", "word"))
    open_rows, buckets = written(signed, "signed"), []
    while True:
        prefix = F.expr(f"shiftrightunsigned(word, {64 - bits})")
        keyed = open_rows.withColumns({"key": prefix, "bits": F.lit(bits)})
        sizes = keyed.groupBy("t", "dim", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = written(keyed.join(sizes, ["t", "dim", "key"]), "buckets")
        buckets.append((met.filter(F.col("n") <= full) if bits < MOST_BITS else met, bits))
        bits = min(2 * bits, MOST_BITS)
        open_rows = met.filter(F.col("n") > full).drop("key", "bits", "n")
        if buckets[-1][1] == MOST_BITS or open_rows.isEmpty():
            break
    whole = buckets[0][0]
    for b, _ in buckets[1:]:
        whole = whole.unionByName(b)
    small = whole.filter(F.col("n") <= full).join(rows.select("id", "v"), "id")
    large = whole.filter(F.col("n") > full)

    def pairs(bucket: pa.Table) -> pa.Table:
        order = np.argsort(bucket.column("id").to_numpy())
        ids = bucket.column("id").to_numpy()[order]
        x = _unit(bucket.column("v").combine_chunks(), bucket.column("dim")[0].as_py())[order]
        c = np.triu(x @ x.T, 1)
        a, b = np.nonzero(c >= least - 1e-12)
        return pa.table({"a": ids[a], "b": ids[b], "cosine": c[a, b]})

    found = small.groupBy("t", "dim", "bits", "key").applyInArrow(pairs, PAIRS)
    first = large.groupBy("t", "dim", "key").agg(F.min("id").alias("a"))
    stars = large.join(first, ["t", "dim", "key"]).select("a", F.col("id").alias("b")).filter("a <> b").distinct()
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    near = stars.join(rows.select(F.col("id").alias("a"), "v"), "a").join(rows.select(F.col("id").alias("b"), F.col("v").alias("w")), "b").select("a", "b", (dot / (length("v") * length("w"))).alias("cosine")).filter(F.col("cosine") >= least - 1e-12)
    out = written(found.unionByName(near).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "similar")
    members = written(members, "members")
    forget(grouped)
    return out, members


def recall(cosine: float, tables: int = TABLES, bits: int = BITS) -> float:
    """The chance that a pair of this cosine meets in a bucket of some table, before any is split."""
    return 1 - (1 - (1 - np.arccos(cosine) / np.pi) ** bits) ** tables
