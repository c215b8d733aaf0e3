"""Documents in hash groups, and packed blocks between groups and hash buckets.

Statistics over billions of hashes move as packed arrays: a group of documents sends one block to each bucket of the hash
space, a bucket answers each group with one block. A group holds about ``GROUP_BYTES`` of text, so a row of a shuffle
stands for thousands of hashes, and both sides are dealt by a uniform hash, whatever the keys' skew is: hashes that are
frequent in a group were summed in the group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text in a group, at least and at most, and groups before they grow; bytes of text for each bucket.
GROUP_BYTES, GROUP_MOST, GROUPS, BUCKET_BYTES = 3 << 20, 128 << 20, 4096, 4 << 20
BLOCK = "bucket int, g int, payload binary"


def plan(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """The numbers of groups and of buckets (a power of two) for the text of all rows."""
    total = text_bytes(docs)
    groups = max(1, -(-total // min(GROUP_MOST, max(GROUP_BYTES, total // GROUPS))))
    return groups, 1 << max(0, (-(-total // bucket_bytes) - 1).bit_length())


def grouped(docs: DataFrame, groups: int, name: str = "g") -> DataFrame:
    """The rows with the group of each in a new column, by its id; rows without an id, which may be many, by their text."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(1))).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.withColumn(name, F.pmod(key, F.lit(groups)).cast("int"))


def ordered(rows: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """doc ids (null is the least number), texts in UTF-8 and row numbers of a group in an order that any run repeats."""
    ids = rows.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    texts = rows.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return ids[order], [texts[k] for k in order], np.array(order, np.int64)


def blocks(bucket: np.ndarray, g: int, payloads: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "g": pa.array(np.full(len(payloads), g), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of 64-bit hashes and the 32 bits that follow the bucket's."""
    bits = np.uint64(buckets.bit_length() - 1)
    return ((h >> (np.uint64(64) - bits)) if bits else np.zeros_like(h)).astype(np.int64), (h << bits >> np.uint64(32)).astype(np.uint32)


def _steps(sorted_low: np.ndarray) -> bytes:
    """Ascending numbers as steps, of which the upper bytes are mostly zeros, for the shuffle's compression."""
    return np.diff(sorted_low, prepend=np.uint32(0)).astype("<u4").tobytes()


def frequent(base: DataFrame, buckets: int, hashes: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """bucket, g, payload: the hashes of each group that occur twice or more in all groups, with their numbers.

    ``hashes`` gives those of a group's texts, repeated as they count. A bucket tells hashes apart by 32 bits: what is
    counted once may, with a chance of the bucket's hashes by 2 ** 32, be taken for more, never the other way.
    """

    def count(rows: pa.Table) -> pa.Table:
        h, n = np.unique(hashes(ordered(rows)[1]), return_counts=True)
        bucket, low = place(h, buckets)
        full, first = np.unique(bucket, return_index=True)  # of as many buckets as the group has, not as there are
        ends = np.append(first[1:], len(bucket))
        return blocks(full, rows.column("g")[0].as_py(), [_steps(low[a:z]) + np.minimum(n[a:z], 2**32 - 1).astype("<u4").tobytes() for a, z in zip(first.tolist(), ends.tolist(), strict=True)])

    def add(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(p, "<u4").reshape(2, -1) for p in rows.column("payload").to_pylist()]
        low = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in sent])
        n = np.concatenate([x[1] for x in sent]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
        total = np.empty(len(low), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(low))))
        out, at = [], 0
        for x in sent:
            own, its = low[at : at + x.shape[1]], total[at : at + x.shape[1]]
            out.append(_steps(own[its > 1]) + np.minimum(its[its > 1], 2**32 - 1).astype("<u4").tobytes())
            at += x.shape[1]
        return pa.table({"bucket": rows.column("bucket"), "g": rows.column("g"), "payload": pa.array(out, pa.binary())})

    return base.select("doc_id", "text", "g").groupBy("g").applyInArrow(count, BLOCK).groupBy("bucket").applyInArrow(add, BLOCK)


def known(h: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The number of each hash by the answers to its group; 1 if they don't have it."""
    table, count = [], []
    for bucket, p in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True)):
        x = np.frombuffer(p, "<u4").reshape(2, -1)
        table.append(np.cumsum(x[0], dtype=np.uint32).astype(np.int64) | bucket << 32)
        count.append(x[1])
    table = np.concatenate(table) if table else np.empty(0, np.int64)
    if not len(table):
        return np.ones(len(h), np.uint32)
    bucket, low = place(h, buckets)
    key = bucket << 32 | low
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, np.concatenate(count)[at], 1)
