"""WARC records as a chunked record table, written and read without holding a record whole.

A row of the table is a chunk: (record, chunk, last, running_sha1, header, data). ``header`` is the record's header block, in
its first row alone; ``data`` has up to ``CHUNK`` bytes of payload, and in the last row the blank lines that end a record, so
headers and data of a record's rows in order are its bytes in WARC/1.1. ``running_sha1`` is the digest of the payload
up to and with that chunk. Records of one row, the most, are read where they lie; the reader deals the rows of the
others by record, sorts them by chunk, and carries digests from row to row.

Of records with equal payloads (by SHA-256 and length), that with the largest page id is the response and the others
revisit it, if payloads have at least ``least`` bytes; smaller payloads are all responses. Null pages
count as empty; null page ids come below all others; of rows with the largest id, repeated, the last one read is
the response. Rows are numbered and written first. Only ids and digests are grouped; payloads move once, to
their role, by a join whose large keys AQE splits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.cluster import new_path, ship, slices, staged

CHUNK = 1 << 20
TABLE = "record string, chunk int, last boolean, running_sha1 binary, header binary, data binary"
_ROW = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("running_sha1", pa.binary()), ("header", pa.binary()), ("data", pa.binary())])
_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, key: str, row: int | None) -> str:
    """Of the response that others refer to: page and payload alone; of another record, with its row's number."""
    return f"urn:page:{'null' if page is None else page}:{key[:32]}" + ("" if row is None else f":{row}")


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def header(record: str, url: str | None, refers: str | None, digest: str, size: int) -> bytes:
    """The header block of a record, a revisit if ``refers`` is given. ``Payload-Length`` is the full payload's, also for revisits, which carry none."""
    clean = "".join(c for c in url or "" if c > " " and c != "\x7f")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    return "\r\n".join([*lines, f"Content-Length: {0 if refers else size}", "", ""]).encode()


def parse_header(raw: bytes) -> dict[str, str]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1" or rest:
        raise ValueError("not a WARC/1.1 header block")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def page_of(record: str) -> int | None:
    found = record.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def record_chunks(head: bytes, payload: memoryview, size: int) -> Iterator[tuple[int, bool, bytes, bytes | None, bytes]]:
    """(chunk, last, running digest, header, data) of one record."""
    sha1 = hashlib.sha1()
    n = max(1, -(-len(payload) // size))
    for k in range(n):
        part = payload[k * size : (k + 1) * size]
        sha1.update(part)
        last = k == n - 1
        yield k, last, sha1.digest(), None if k else head, bytes(part) + b"\r\n\r\n" * last


def plan_records(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """(row, page, url, payload, key, size, sha1, first) for every row; ``first``: whether it is its group's response, null for small payloads; ``response``: that one's page."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("page"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("bigint"))
    rows = staged(rows, "pages")  # row numbers hold for both uses below only once they are written
    rank = F.struct(F.col("page").isNotNull().alias("known"), "page", "row")
    firsts = rows.groupBy("key", "size").agg(F.max(rank).alias("top")).select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("top.page").alias("response"), F.col("top.row").alias("top_row"))
    joined = rows.join(firsts, (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))
    first = F.when(F.col("size") >= least, F.col("row") == F.col("top_row"))
    return joined.select("row", "page", "url", "key", "size", base32(F.sha1("payload")).alias("sha1"), first.alias("first"), "response", F.when(F.coalesce(first, F.lit(True)), F.col("payload")).alias("payload"))


def record_table(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None = None, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunks of every page's record."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            bodies = batch.column(8)
            for i, (row, page, url, key, size, sha1, first, response) in enumerate(zip(*columns, strict=True)):
                body = bodies[i].as_buffer()
                record = record_id(page, key, None if first else row)
                refers = record_id(response, key, None) if first is False else None
                for k, last, digest, head, data in record_chunks(header(record, url, refers, sha1, size), memoryview(body) if body is not None else memoryview(b""), chunk):
                    held.append((record, k, last, digest, head, data))
                    n += len(data)
                    if n >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)

    return plan_records(pages, id_col, payload_col, url_col, least).mapInArrow(write, TABLE)


def write_records(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 0, chunk: int = CHUNK) -> None:
    record_table(pages, id_col, payload_col, url_col, least, chunk).write.option("compression", "zstd").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(TABLE)).parquet(path)


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


class RecordReader:
    """Takes the chunks of records in order; a record's fields come back with its last chunk."""

    def __init__(self) -> None:
        self.record: str | None = None

    def take(self, record: str, chunk: int, last: bool, running: bytes, head: bytes | None, data: memoryview) -> tuple | None:
        if chunk == 0:
            if self.record is not None:
                raise ValueError(f"record {self.record} has no end")
            self.record, self.fields, self.sha1, self.size, self.next = record, parse_header(head), hashlib.sha1(), 0, 0
        if record != self.record or chunk != self.next:
            raise ValueError(f"record {record} lacks a chunk before {chunk}")
        part = data[: len(data) - 4] if last else data
        self.sha1.update(part)
        self.size += len(part)
        self.next += 1
        if self.sha1.digest() != running or last and bytes(data[len(data) - 4 :]) != b"\r\n\r\n":
            raise ValueError(f"record {record}, chunk {chunk}: damaged")
        if not last:
            return None
        self.record, f = None, self.fields
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        if self.size != int(f["content-length"]) or f["warc-type"] == "response" and base32_sha1(running) != digest:
            raise ValueError(f"record {record}: its payload doesn't match its header")
        refers = page_of(f["warc-refers-to"]) if "warc-refers-to" in f else None
        return page_of(f["warc-record-id"]), int(f["payload-length"]), digest, f["warc-type"], refers


def read_records(chunks: DataFrame) -> DataFrame:
    """``READ`` of every record, its payload's length and digest checked chunk by chunk."""
    ship(chunks.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RecordReader()
        for batch in slices(batches, 512):
            data = batch.column(5)
            done = [reader.take(*x, memoryview(data[i].as_buffer())) for i, x in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))]
            rows = [x for x in done if x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
        if reader.record is not None:
            raise ValueError(f"record {reader.record} has no end")

    alone = F.expr("chunk = 0 and last")
    several = chunks.where(~alone).repartition("record").sortWithinPartitions("record", "chunk")
    return chunks.where(alone).mapInArrow(read, READ).union(several.mapInArrow(read, READ))


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages' archive to the shared folder and returns what reading it back gives."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_records(pages, path, least=least)
    return read_records(read_chunks(spark, path))


def export_warc(chunks: DataFrame, folder: str, shards: int = 16) -> None:
    """Plain .warc files from the table, into a folder that all executors see as a path: each file is complete before it gets its name."""
    ship(chunks.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(folder, f"part-{context.partitionId():05d}.warc")
        part = f"{name}.{context.taskAttemptId()}.tmp"
        n = 0
        with open(part, "wb") as f:
            for batch in batches:
                for i in range(batch.num_rows):
                    n += f.write(batch.column(4)[i].as_py() or b"") + f.write(batch.column(5)[i].as_buffer())
        os.replace(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["bytes"])

    chunks.repartition(shards, "record").sortWithinPartitions("record", "chunk").mapInArrow(write, "bytes bigint").count()


def base32(hexed: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal string: 5 hex digits are 4 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):
        number = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [letters.substr(F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)
