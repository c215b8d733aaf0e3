"""Exact top-k inner products by tiled matrix products.

Vectors are dealt by a hash of their id into shards of about ``SHARD`` rows, queries into blocks of about ``BLOCK``
rows, each packed into one row. A shard holds vectors of like width (up to the same power of two) and fewer rows of wide
ones, ``CELLS`` numbers at most or one row, so a wide vector widens no narrow ones. Every block meets every shard once: a tile is one matrix product, of which the k best
of each query are selected at once, and lists are merged in a tree of ``FAN`` lists a step, so no task holds more than
a tile or FAN lists however many shards there are.

Components become floor(64 * x), packed in two bytes each where they fit. Products are exact: in single precision where
no sum can pass 2 ** 24, in double precision where none can pass 2 ** 53, else in Python's integers, also where 64 * x is
beyond the largest double. Results: vectors that are null, empty, or hold a null, NaN or infinity take no part; a shorter
vector counts as padded with zeros, and a product is cut at the shorter side's width; equal scores go to the smaller id;
rows that repeat an id are candidates each, but rows with the query's own id are its own; null ids take no part; scores
beyond 64 bits are held at the largest 64-bit number (the SQL covers scores within 64 bits); other columns are left out;
no rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of a shard and of a query block, lists merged in one step, results of a query, and what divides a query's id.
SHARD, BLOCK, FAN, K, EVERY = 8192, 1024, 16, 20, 20
#: Numbers of a shard or query block at most, unless one row has more.
CELLS = 1 << 21
LISTS = "block int, shard int, queries binary, vectors binary, scores binary"


def _packed(vectors: DataFrame, name: str) -> DataFrame:
    """One row a group: number, ids and matrix, in ascending order of ids."""

    def pack(rows: pa.Table) -> pa.Table:
        lists = rows.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ids = rows.column("vec_id").to_numpy()
        matrix = np.zeros((len(ids), int(sizes.max())))
        matrix[np.repeat(np.arange(len(ids)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({name: pa.array([rows.column(name)[0].as_py()], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "matrix": [pack_matrix(matrix[order])], "dim": pa.array([matrix.shape[1]], pa.int32())})

    return vectors.groupBy(name).applyInArrow(pack, f"{name} int, ids binary, matrix binary, dim int")


def _dealt(rows: dict[int, int], most: int) -> tuple[Column, int]:
    """The group of a vector by its width and a hash of its id, and the number of groups."""
    first, parts, groups = [0] * 33, [1] * 33, 0
    for bits, n in rows.items():
        first[bits], parts[bits] = groups, -(-n // max(1, min(most, CELLS >> bits)))
        groups += parts[bits]
    of = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("bits") + 1)
    return (of(first) + F.pmod(F.xxhash64("vec_id"), of(parts))).cast("int"), max(1, groups)


def pack_matrix(x: np.ndarray) -> bytes:
    """floor(64 x) in two bytes where all fit, else x itself."""
    if np.abs(x).max(initial=0) < 511:
        return b"i" + np.floor(64.0 * x).astype("<i2").tobytes()
    return b"f" + x.astype("<f8").tobytes()


def unpack_matrix(raw: bytes, dim: int) -> np.ndarray:
    """floor(64 x) as doubles, or as Python's integers where some are beyond the largest double."""
    if raw[:1] == b"i":
        return np.frombuffer(raw, "<i2", offset=1).reshape(-1, dim).astype(np.float64)
    x = np.frombuffer(raw, "<f8", offset=1).reshape(-1, dim)
    if np.abs(x).max(initial=0) < 2.0**1000:
        return np.floor(64.0 * x)
    return np.frompyfunc(lambda v: math.floor(64 * v) if abs(v) < 2.0**1000 else 64 * int(v), 1, 1)(x)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    if q.dtype != object and v.dtype != object:
        bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, dim)
        if bound < 2.0**24:
            return (q.astype(np.float32) @ v.T.astype(np.float32)).astype(np.int64)
        if bound < 2.0**53:
            return (q @ v.T).astype(np.int64)
    most = 2**63 - 1
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q).dot(whole(v).T), -most, most).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each query's k best; columns are in ascending order of ids, so a smaller one wins a tie."""
    n, m = scores.shape
    free = ids[None, :] != own[:, None]
    if m > 4 * k:
        cut = np.partition(np.where(free, scores, np.iinfo(np.int64).min), m - k, axis=1)[:, m - k]
        free &= scores >= cut[:, None]
    rows, columns = np.nonzero(free)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(n))
    top = np.arange(len(rows)) - first[rows] < k
    return rows[top], columns[top], scores[rows[top], columns[top]]


def search(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query; queries are rows whose vec_id is divisible by ``every``."""
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    valid = valid.withColumn("bits", F.expr("length(bin(size(v) - 1))"))  # of the width, less one: 32 at most
    widths = sorted(tuple(r) for r in valid.groupBy("bits").agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).collect())
    shard_of, shards = _dealt({bits: n for bits, n, _ in widths}, shard)
    block_of, _ = _dealt({bits: n for bits, _, n in widths if n}, block)
    packed = _packed(valid.withColumn("shard", shard_of), "shard")
    asked = _packed(valid.filter(F.col("vec_id") % every == 0).withColumn("block", block_of), "block").select("block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dim").alias("q_dim"))
    tiles = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(packed, "shard")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = {c: b.column(c)[i].as_py() for c in b.schema.names}
                q_ids, ids = np.frombuffer(t["q_ids"], "<i8"), np.frombuffer(t["ids"], "<i8")
                rows, columns, scores = _best(_scores(unpack_matrix(t["q_matrix"], t["q_dim"]), unpack_matrix(t["matrix"], t["dim"])), ids, q_ids, k)
                yield _list(t["block"], t["shard"], q_ids[rows], ids[columns], scores)

    lists, left = tiles.mapInArrow(tile, LISTS), shards
    while left > 1:
        left = -(-left // FAN)
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN}").cast("int")).groupBy("block", "shard").applyInArrow(lambda t: _merge(t, k), LISTS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, v, s = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("queries", "vectors", "scores"))
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
                yield pa.record_batch([pa.array(q), pa.array(rank, pa.int32()), pa.array(v), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows_of, "query_id long, rank int, vec_id long, score long")


def _list(block: int, shard: int, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (q, v, s))], ["block", "shard", "queries", "vectors", "scores"])


def _merge(lists: pa.Table, k: int) -> pa.Table:
    q, v, s = (np.concatenate([np.frombuffer(x, "<i8") for x in lists.column(c).to_pylist()]) for c in ("queries", "vectors", "scores"))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.Table.from_batches([_list(lists.column("block")[0].as_py(), lists.column("shard")[0].as_py(), q[top], v[top], s[top])])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) as bigint) as score
      from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""
