"""Packing into windows by Karmarkar-Karp multiway differencing.

A partition is one stream of documents. Whole windows of a document's ids are sequences of their own. What is left of
documents is cut into pieces of at most ``piece`` ids and gathered until a block of ``windows`` windows is full but for
a slack; differencing then merges partial partitions, largest spread first, opposing their imbalances, which gives
near-equal windows. If the fullest exceeds the capacity, the block is partitioned again into one window more. The room
that a block's windows have left is filled with cuts of the documents that follow, so only a partition's end is padded.

Only ids counts leave a batch, no shuffle is needed, and a block is the most that is held. Sequence numbers carry the
partition in their upper bits, so that a task that runs again gives the same numbers. Results: a null text is empty and
its end id is packed alone; a very long text is many whole windows and one tail; repeated rows are packed each; equal
sizes are taken in the order of the stream; other columns are left out; no rows give none.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import bounded, table

#: Ids of a sequence, windows of a block, the largest piece of a tail, free ids left in a window on average, and the end id.
CAPACITY, WINDOWS, PIECE, SLACK, END_ID = 2048, 32, 1024, 64, 1


def differencing(sizes: list[int], k: int) -> list[int]:
    """The number 0 ... k - 1 of the part of each item, by largest differencing.

    A partial partition is its nonempty parts as (sum, node), largest first; the empty ones are not stored.
    """
    n = len(sizes)
    if k == 1 or not n:
        return [0] * n
    children: list[tuple[int, int]] = []  # of node n + j: two nodes whose items go together
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        free = k - len(two)  # this many largest parts of the one meet empty parts of the other
        merged = one[:free]
        for (s, x), (t, y) in zip(one[free:], reversed(two), strict=False):
            merged.append((s + t, n + len(children)))
            children.append((x, y))
        merged += two[: k - max(free, len(one))] if len(one) > free else two
        merged.sort(reverse=True)
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], order, merged))
        order += 1
    part = [0] * n
    for j, (_, node) in enumerate(heap[0][2]):
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                part[x] = j
            else:
                todo += children[x - n]
    return part


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], int]:
    """Parts within the capacity, and their number: the least that could hold all, or more until the fullest fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        part = differencing(sizes, k)
        if not sizes or np.bincount(part, sizes, k).max() <= capacity:
            return part, k
        k += 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: where its ids start in their document and in their sequence."""
    path = vocabulary or bpe.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, context = bpe.encoder(path, "library"), TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        rows: list[tuple] = []
        used, tails, held = 0, [], 0

        def block(pieces: list[tuple]) -> None:
            nonlocal used
            part, k = windows_of([p[2] for p in pieces], capacity)
            fill = [0] * k
            for p, j in zip(pieces, part, strict=True):
                rows.append((*p, base + used + j, fill[j]))
                fill[j] += p[2]
            room.extend((base + used + j, n) for j, n in enumerate(fill) if n < capacity)
            used += k

        room: list[tuple[int, int]] = []  # sequences that are not full, and the ids they have
        most = windows * (capacity - SLACK)
        for b in bounded(batches):
            ids = b.column("doc_id").to_pylist()
            flat, starts = coder.encode_all(b.column("text").to_pylist())
            for doc, a, z in zip(ids, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = np.append(flat[a:z], end_id).astype("<u4")
                n, at = len(own), 0
                while at < n:
                    if n - at < capacity and room:
                        sequence, offset = room.pop()
                        size = min(n - at, capacity - offset)
                        rows.append((doc, at, size, zlib.crc32(own[at : at + size]), n, sequence, offset))
                        if offset + size < capacity:
                            room.append((sequence, offset + size))
                        at += size
                        continue
                    size = capacity if n - at >= capacity else min(piece, n - at, most - held)
                    row = (doc, at, size, zlib.crc32(own[at : at + size]), n)
                    at += size
                    if size == capacity:
                        rows.append((*row, base + used, 0))
                        used += 1
                        continue
                    tails.append(row)
                    held += size
                    if held == most:
                        block(tails)
                        tails, held = [], 0
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows.clear()
        coder.rest()
        if tails:
            block(tails)
        if rows:
            yield batch_of(rows)

    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
