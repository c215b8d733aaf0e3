"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import math
import posixpath
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only on a local master, where all run on one machine, a folder of its own stands in for an unset one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Folders of tables, and of files that go with them, by the frame that reads them, for ``forget``.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, tuple[str, ...]] = weakref.WeakKeyDictionary()


def written(frame: DataFrame, label: str, instead: DataFrame | None = None, beside: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives executors.

    ``instead`` is a frame that ``written`` gave and that nothing needs any more; its table is deleted. ``beside`` is a
    folder of files that the rows name; it is deleted with the table.
    """
    spark, path = frame.sparkSession, scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    if instead is not None:
        forget(instead)
    out = spark.read.schema(frame.schema).parquet(path)
    _FOLDERS[out] = (path, beside) if beside else (path,)
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that ``written`` gave."""
    for frame in frames:
        for path in _FOLDERS.pop(frame, ()):
            files, folder = store(path)
            if files.get_file_info(folder).type.name == "Directory":  # no file, no folder
                files.delete_dir(folder)


def dealt(frame: DataFrame, rows: int, *keys: str, each: int = 500_000, few: int = 8) -> DataFrame:
    """The frame by hashes of its keys in parts of so many of ``rows``, for what sorts or counts by them; as it is, where parts would be few."""
    n = math.ceil(rows / each)
    return frame.repartition(n, *keys) if n > few else frame


def move(old: DataFrame, new: DataFrame) -> None:
    """From now on the table behind the old frame goes with the new one, which is made from it."""
    _FOLDERS[new] = _FOLDERS.pop(old)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a whole file under another name and renames it, so that a task that is run again leaves the same file."""
    files, path = store(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def write_files(frame: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``value`` as the file ``path`` below the folder, and gives path and bytes of each, read lazily."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True))
            data = [(v or "").encode() for _, v in rows]
            for (path, _), x in zip(rows, data, strict=True):
                put(f"{folder}/{path}", x)
            yield pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([len(x) for x in data], pa.int64())], ["path", "bytes"])

    return frame.select("path", "value").mapInArrow(run, "path string, bytes long")
