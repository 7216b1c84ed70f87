"""WARC records in ZIP archives, read by ranges through the archive's own directories."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, shared_dir, table

#: Neighbouring records that are read by one range, in bytes.
READ_BYTES = 1 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class Ranges(Protocol):
    """Something of known size that gives any range of its bytes."""

    size: int

    def read(self, start: int, length: int) -> bytes: ...


class BytesRanges:
    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, start: int, length: int) -> bytes:
        return bytes(self.data[start : start + length])


class FileRanges:
    """A seekable file object."""

    def __init__(self, file):
        file.seek(0, io.SEEK_END)
        self.file, self.size = file, file.tell()

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipDirectory:
    """The members of a ZIP by its central directory (ZIP64 too); stored members can be read in part."""

    def __init__(self, source: Ranges):
        self.source = source
        tail_at = max(0, source.size - 22 - 65535 - 20)
        tail = source.read(tail_at, source.size - tail_at)
        if (end := tail.rfind(b"PK\x05\x06")) < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at64,) = struct.unpack_from("<Q", tail, end - 12)
            record = source.read(at64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._parse(source.read(at, size), count)}

    @staticmethod
    def _parse(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            more, end = at + 46 + n, at + 46 + n + extra
            while more + 4 <= end:
                kind, length = struct.unpack_from("<HH", data, more)
                if kind == 1:  # ZIP64: only the fields that are full elsewhere, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", data, more + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                more += 4 + length
            yield Member(name, method, size, header)
            at = end + comment

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in part")
        local = self.source.read(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        length = member.size - start if length is None else length
        if start < 0 or start + length > member.size:
            raise ValueError("range outside the member")
        return self.source.read(member.header + 30 + n + extra + start, length)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload if ``refers_to`` is given."""
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, bytes of the full payload, and the payload (None for a revisit), whose digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "revisit":
        return fields, size, None
    if len(payload) != size or "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return fields, size, payload


class ArchiveWriter:
    """One ZIP: gzipped records behind each other in a stored member, and a stored index of their ranges."""

    def __init__(self):
        self.records, self.index = io.BytesIO(), []

    @property
    def size(self) -> int:
        return self.records.tell()

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        at = self.size
        self.records.write(gzip.compress(warc_record(page_id, url, payload, refers_to), 1, mtime=0))
        self.index.append(json.dumps({"id": page_id, "offset": at, "length": self.size - at}))

    def finish(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(WARC), self.records.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        return out.getvalue()


def read_archive(source: Ranges) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """Every record by the index, neighbours by one range read of about READ_BYTES; nothing else of the archive is read."""
    directory = ZipDirectory(source)
    entries = [json.loads(line) for line in directory.read(INDEX).decode().splitlines()]
    first = 0
    while first < len(entries):
        last, at = first, entries[first]["offset"]
        while last + 1 < len(entries) and entries[last + 1]["offset"] + entries[last + 1]["length"] - at <= READ_BYTES:
            last += 1
        data = memoryview(directory.read(WARC, at, entries[last]["offset"] + entries[last]["length"] - at))
        for entry in entries[first : last + 1]:
            yield parse_record(gzip.decompress(data[entry["offset"] - at : entry["offset"] - at + entry["length"]]))
        first = last + 1


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and the path in it: local, or what pyarrow can reach by its URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id with an equal payload, null if the row is that or too small.

    Payloads are equal if their SHA-256 and length are. Digests alone are grouped; pages that repeat another
    are joined back by id and digest, so a payload that many pages have is in no single task.
    Null html counts as empty, null ids never are referred to, and rows that repeat with one id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    firsts = digests.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "refers_to")
    repeats = digests.join(firsts, "digest").where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    r, s = rows.withColumn("digest", F.sha2("payload", 256)).alias("r"), repeats.alias("s")
    on = F.col("r.page_id").eqNullSafe(F.col("s.page_id")) & (F.col("r.digest") == F.col("s.digest"))
    return r.join(s, on, "left").select("r.page_id", "r.url", "r.payload", "s.refers_to")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive (its path), bytes and records of ZIPs of about ``archive_bytes`` that the rows of ``mark_revisits`` are written to.

    ``folder`` must be one that all executors share. Names hold the attempt of their task, so a repeated or speculative task meets no file
    of another; only the rows of the attempt that counts name archives, and what others wrote is never read.
    """
    bounded_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, writer = TaskContext.get(), 0, ArchiveWriter()
        files, root = storage(folder)
        files.create_dir(root, recursive=True)

        def flush() -> pa.RecordBatch:
            name, data = f"{task.partitionId():06d}-{n:06d}-{task.taskAttemptId()}.zip", writer.finish()
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)]), pa.array([len(writer.index)])], ["archive", "bytes", "records"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                writer.add(*row)
                if writer.size >= archive_bytes:
                    yield flush()
                    n, writer = n + 1, ArchiveWriter()
        if writer.size:
            yield flush()

    return records.mapInArrow(write, "archive string, bytes long, records long")


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives whose paths are in the column ``archive``, read by ranges where they lie.

    A damaged archive or payload raises an error.
    """
    bounded_batches(archives.sparkSession)
    schema = RECORD if payloads else RECORD.remove(5)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                files, place = storage(path)
                with files.open_input_file(place) as file:
                    rows = []
                    for fields, size, payload in read_archive(FileRanges(file)):
                        refers = fields.get("WARC-Refers-To")
                        rows.append((_page(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], refers and _page(refers)) + ((payload,) if payloads else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return archives.select("archive").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    written = materialise(write_archives(mark_revisits(table(spark, sf_dir, "pages")), folder), "archives")
    return read_archives(written.repartition(F.col("archive")))


ORACLE_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(x, i::INT, 1)) - 3, 4)), '') AS b
  FROM payloads
)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * g::INT + 1, 1)::INT
         + 8 * substr(b, 5 * g::INT + 2, 1)::INT + 4 * substr(b, 5 * g::INT + 3, 1)::INT + 2 * substr(b, 5 * g::INT + 4, 1)::INT + substr(b, 5 * g::INT + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM bits
"""
