"""WARC archives with a two-level capture index.

``archive`` finds, by digest and length, which pages repeat a payload, writes one gzip member a record into files of
about ``FILE_BYTES``, sorts the captures by reversed-host URL key and writes them as compressed index blocks of ``LINES``
lines. A part of the index is an ``.idx`` file of blocks and a sparse ``.dir`` file: the first key, the offset and the
size of each block. ``CaptureIndex.find`` searches the parts' first keys, then a directory, and reads only the blocks and
the records that it needs; ``read_back`` goes through every block of the index, reads every record at its range, and
checks length and digest of each payload.

Payloads are compared and counted before any of them is moved: what is dealt by digest is a row of numbers, hot digests
are summed before the shuffle and their pages are spread over ``SALTS`` partitions. Results: a null html is an empty
payload; a null url has the empty key; payloads under ``LEAST`` bytes and rows that repeat the largest page_id are
responses; a page without page_id is never the response of a group that has ids; a very long html is one record; other
columns are left out; no rows give no files and no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import put, read_range, scratch, table

#: Bytes of a WARC file, lines of an index block, bytes from which payloads are shared, partitions of a hot digest.
FILE_BYTES, LINES, LEAST, SALTS = 32 << 20, 256, 1000, 16
#: Rows of pages for each partition of the archive and of the index.
PAGES, CAPTURES = 2000, 20_000
#: Bytes between two records that are read rather than skipped, and bytes of a read of several records.
NEAR, READ_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, path string, offset long, size long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then port, path and query, in lower case: com,example,www)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    head = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{head}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower() if host else (url or "").lower()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html with digest (hex SHA-1), size, and ``target``: the page whose payload a revisit repeats, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    groups = p.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url")).filter("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = (F.col("page_id") != F.col("last")) | (F.col("page_id").isNull() & F.col("last").isNotNull())
    return p.join(groups, ["digest", "size", "salt"], "left").withColumns({"target": F.when(again, F.col("last")), "target_url": F.when(again, F.col("last_url"))}).drop("salt", "last", "last_url")


def record(page: dict) -> bytes:
    """A WARC 1.1 record; its HTTP headers keep the length of the whole payload, in a revisit too."""
    revisit = page["target"] is not None
    payload = page["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    safe = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page['page_id'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe(page['url'])}", f"WARC-Payload-Digest: sha1:{page['digest']}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(page['target'])}", f"WARC-Refers-To-Target-URI: {safe(page['target_url'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """A gzip member's record: its headers, its payload (None for a revisit) and the payload's whole length."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    return {"headers": headers, "payload": None if headers["WARC-Type"] == "revisit" else payload, "length": length}


def checked(r: dict) -> tuple:
    """page_id, length and SHA-1 of the payload, type and target of a parsed record.

    Of a response the length and digest are those of the payload that was read, and must be what the headers say; a
    revisit has no payload, and its headers tell.
    """
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None  # noqa: E731  of <urn:page:7>
    h, length = r["headers"], r["length"]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if r["payload"] is not None:
        read = len(r["payload"]), hashlib.sha1(r["payload"]).hexdigest()
        if read != (length, digest):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} is not what its headers say")
        length, digest = read
    return number(h["WARC-Record-ID"]), length, digest, h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None


def _members(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of (file, offset, size) in order of file and offset; ranges of one file near each other are read at once."""
    at = 0
    while at < len(rows):
        path, start, _ = rows[at]
        stop, end = at, start
        while stop < len(rows) and rows[stop][0] == path and rows[stop][1] - end <= NEAR and (stop == at or rows[stop][1] + rows[stop][2] - start <= READ_BYTES):
            end = rows[stop][1] + rows[stop][2]
            stop += 1
        held = read_range(path, start, end - start)
        for _, offset, size in rows[at:stop]:
            yield held[offset - start : offset - start + size]
        at = stop


def archive(pages: DataFrame, folder: str, least: int = LEAST) -> list:
    """Writes archives and index; returns the index parts in the order of their keys: first key, name, captures."""
    spark = pages.sparkSession
    n = pages.count()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, found = TaskContext.get().partitionId(), 0, bytearray(), []

        def close() -> pa.RecordBatch:
            nonlocal nth, held
            put(name(), bytes(held))
            nth, held = nth + 1, bytearray()
            out = pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))
            found.clear()
            return out

        def name() -> str:
            return f"{folder}/warc-{part:06d}-{nth:04d}.warc.gz"

        for b in batches:
            for i in range(b.num_rows):
                page = {c: b.column(c)[i].as_py() for c in b.schema.names}
                member = gzip.compress(record(page), 3, mtime=0)
                found.append({"key": url_key(page["url"]), "page_id": page["page_id"], "path": name(), "offset": len(held), "size": len(member)})
                held += member
                if len(held) >= FILE_BYTES:
                    yield close()
        if found:
            yield close()

    # pages stay where the join dealt them, so they move once; the order gives a task that runs again the same file
    captures = roles(pages, least).sortWithinPartitions("page_id", "url", "digest").mapInArrow(write, CAPTURE)
    table_of = scratch(spark, "captures")
    captures.write.parquet(table_of)  # the index is sorted from what was written, not from archives written twice
    captures = spark.read.schema(CAPTURE).parquet(table_of)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, directory, lines, first, n = f"{folder}/index-{TaskContext.get().partitionId():06d}", bytearray(), [], [], None, 0

        def close() -> None:
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([json.loads(lines[0])[0], len(blocks), len(block)])
            blocks.extend(block)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = row[0] if first is None else first
                lines.append(json.dumps(row))
                n += 1
                if len(lines) == LINES:
                    close()
        if n:
            if lines:
                close()
            put(f"{part}.idx", bytes(blocks))
            put(f"{part}.dir", json.dumps(directory).encode())
            yield pa.record_batch([pa.array([first]), pa.array([part]), pa.array([n], pa.int64())], ["first", "part", "n"])

    parts = captures.repartitionByRange(max(1, -(-n // CAPTURES)), "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(index, "first string, part string, n long").collect()
    return sorted(parts, key=lambda r: r.part)


def _lines(part: str, entry: list) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(read_range(f"{part}.idx", entry[1], entry[2])).decode().split("\n")]


class CaptureIndex:
    """Looks up captures by URL: parts, then a part's sparse directory, then blocks, then records."""

    def __init__(self, parts: list) -> None:
        self.parts = parts

    def find(self, url: str) -> list[dict]:
        """The records of all captures of a URL."""
        key, out = url_key(url), []
        firsts = [p.first for p in self.parts]
        for p in self.parts[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
            directory = json.loads(read_range(f"{p.part}.dir"))
            keys = [d[0] for d in directory]
            for d in directory[max(0, bisect.bisect_left(keys, key) - 1) : bisect.bisect_right(keys, key)]:
                out += [parse(read_range(path, offset, size)) for k, _, path, offset, size in _lines(p.part, d) if k == key]
        return out


def read_back(spark: SparkSession, parts: list) -> DataFrame:
    """A row for each capture in the index, from its record."""
    if not parts:
        return spark.createDataFrame([], RECORD)
    sources = spark.createDataFrame([(p.part,) for p in parts], "part string")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("part").to_pylist():
                directory = json.loads(read_range(f"{part}.dir"))
                yield pa.record_batch([pa.array([part] * len(directory)), *(pa.array([d[k] for d in directory], pa.int64()) for k in (1, 2))], ["part", "offset", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, offset, size in zip(*(b.column(c).to_pylist() for c in ("part", "offset", "size")), strict=True):
                ranges = sorted((path, at, length) for _, _, path, at, length in _lines(part, ["", offset, size]))
                rows = [checked(parse(member)) for member in _members(ranges)]
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    listed = sources.repartition(min(len(parts), 1024)).mapInArrow(blocks, "part string, offset long, size long")
    return listed.repartition(max(1, min(-(-sum(p.n for p in parts) // PAGES), 4096))).mapInArrow(read, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, archive(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


SQL = """
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to from m
"""
