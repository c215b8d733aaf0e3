"""BPE encoding and decoding of whole texts.

``encode`` and ``decode`` are maps over Arrow batches: no shuffle, memory bounded by a batch of 12 MB of text or one text.
Results: a null text gives no ids and the empty string; a very long text is one pass; rows, also equal ones, repeat as often
as given and have equal results; columns besides the id and the text are left out; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import bounded, table


def encode(docs: DataFrame, vocabulary: str | None = None, words: str = "backtracking") -> DataFrame:
    """doc_id and ids (array of int) of each text."""
    path = vocabulary or bpe.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            flat, starts = bpe.encoder(path, words).encode_all(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])
        bpe.encoder(path, words).rest()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of each array of ids, as the tokenizers library joins them with special tokens kept."""
    path = vocabulary or bpe.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [bpe.encoder(path).decode(np.array(ids or [], np.int64)).decode() for ids in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes again in one pass and returns the count of ids and the SHA-256 of the ids and of the decoded text."""
    path = vocabulary or bpe.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for b in bounded(batches):
            flat, starts = coder.encode_all(b.column("text").to_pylist())
            columns = [b.column("doc_id"), pa.array(np.diff(starts), pa.int64())]
            for entries in (coder.decimals, coder.decoder):
                joined = memoryview(entries.gather(flat))
                ends = np.concatenate([[0], np.cumsum(entries.sizes[flat])])[starts].tolist()
                columns.append(pa.array([hashlib.sha256(joined[a : max(a, z - 1)]).hexdigest() for a, z in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.rest()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
