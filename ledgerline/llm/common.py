"""What the corpus operators share: tables, the shared scratch folder, bounded Arrow batches and files on any store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import forget, put, scratch, store, written

__all__ = ["forget", "put", "scratch", "store", "written"]

#: Bytes of text that a Python step holds at once.
BATCH_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owning(frame: DataFrame, table: DataFrame) -> DataFrame:
    """The frame, made from a table that ``written`` gave; to forget it deletes that table."""
    shared.move(table, frame)
    return frame


def unused(frame: DataFrame, stem: str) -> str:
    """A column name that the frame has not, whatever the case of its letters."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def quoted(name: str) -> str:
    """A column name as an expression, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


#: Tasks over which the rows of one key are dealt at most.
SALTS = 64


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Rows joined with the one row of their key in ``one``, however many rows a key has.

    A key's rows are dealt by a hash of ``by`` over up to ``SALTS`` tasks; the one row is repeated for those salts of its
    key that occur, so a key of few rows costs no more copies than it has rows.
    """
    salt = unused(rows, "_salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select(key, salt).distinct().join(one, key), [key, salt], how).drop(salt)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows, by which partitions are sized."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many bytes of text, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > start and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def read_range(uri: str, start: int = 0, size: int | None = None) -> bytes:
    files, path = store(uri)
    with files.open_input_file(path) as f:
        return f.read_at(f.size() if size is None else size, start)
