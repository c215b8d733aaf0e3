"""Token ids in binary files of patched frame-of-reference blocks.

``write`` sorts documents by id over a range partitioning (by a hash of the text where ids are equal, so that what is sampled
for the ranges holds no texts), encodes them and writes files of about ``FILE_IDS`` ids in the shared folder; a document
lies in one file whole. It gives a manifest, a row a file. A file is written under another name and renamed, so a task that runs again replaces it with the same bytes. ``read`` reads manifest rows in parallel.

Results: a null text is empty and gets the end id alone; a very long text lies in one file, which it may fill; rows that
repeat are written each; equal and null ids are in the order of a hash of their texts, then of their texts, so that a run again gives the same bytes;
null ids come first and are kept in the manifest's ``no_id`` count; other columns are left out; no rows give no files
and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import in_order
from . import bpe, pfor
from .common import bounded, put, read_range, scratch, table, text_bytes, written

#: Ids after which a file ends, the end id, and bytes of text for each range partition.
FILE_IDS, END_ID, PARTITION_BYTES = 4_000_000, 1, 24 << 20
#: Tasks that read files at most.
READERS = 65_536
MANIFEST = "part int, nth int, path string, docs long, ids long, no_id long"


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all files; path, docs, ids, no_id and start (ids of all files before) of each, a row a file of millions of ids.

    Starts are running sums over the manifest, which is a table in the shared folder and never comes to the driver.
    """
    path = vocabulary or bpe.vocabulary()
    parts = max(1, -(-text_bytes(docs) // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, nth = bpe.encoder(path, "library"), TaskContext.get().partitionId(), 0
        ids, tokens, counts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal nth, held
            name = f"{folder}/part-{part:06d}-{nth:04d}.lpf"
            put(name, pfor.encode(np.concatenate(tokens), np.array([i or 0 for i in ids], np.int64), np.concatenate(counts)))
            row = [[part], [nth], [name], [len(ids)], [held], [sum(i is None for i in ids)]]
            nth, held = nth + 1, 0
            for x in (ids, tokens, counts):
                x.clear()
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "nth", "path", "docs", "ids", "no_id"])

        for b in bounded(batches):
            flat, starts = coder.encode_all(b.column("text").to_pylist())
            ids += b.column("doc_id").to_pylist()
            counts.append(np.diff(starts) + 1)
            tokens.append(np.insert(flat, starts[1:], end_id))
            held += len(tokens[-1])
            if held >= FILE_IDS:
                yield close()
        if ids:
            yield close()
        coder.rest()

    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    files = written(ordered.mapInArrow(run, MANIFEST), "files")
    placed = in_order(files, ["part", "nth"], "ids")
    return written(placed.select("path", "docs", "ids", "no_id", (F.col("running") - F.col("ids")).alias("start")), "manifest", instead=files)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the ids of each document, from the files."""
    return _reader(manifest, "ids array<long>", lambda own: pa.array([x.tolist() for x in own], pa.list_(pa.int64())))


def digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the document's ids as little-endian uint32, from the files."""
    return _reader(manifest, "ids_crc32 long", lambda own: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()))


def _reader(manifest: DataFrame, last: str, of) -> DataFrame:
    files = manifest.select("path", "start", "no_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                file = pfor.Reader(read_range(f["path"]))
                numbers, stops = file.read(), np.cumsum(file.counts)
                starts = stops - file.counts
                for k in range(0, len(stops), 2000):
                    some = slice(k, k + 2000)
                    ids = [None if j < f["no_id"] else i for j, i in enumerate(file.doc_ids[some].tolist(), k)]
                    own = [numbers[x:y] for x, y in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts[some] + f["start"], pa.int64()), pa.array(file.counts[some], pa.int64()), of(own)], ["doc_id", "start", "n_tokens", last.split()[0]])

    return files.repartition(max(1, min(manifest.count(), READERS))).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
