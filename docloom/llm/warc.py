"""WARC archives: a deduplicating writer and a splittable reader.

Archives are files of gzip members, a record each. The reader cuts files into byte
ranges; a task looks for gzip magic in its range, tests a candidate by decoding the
record's header from it, and reads the records that start inside the range, to their
end wherever that is. Ranges are independent, so a lost task is simply run again.

Null and edge cases: a null html is the empty payload; a null url an empty one; null
page ids are written as 'null' and read back as null (they are never the response that
others refer to); rows with equal page_id and payload are written as often as they come
and of equal type; an empty table gives no archives and no records; other columns are
not written. Records may be of any size; one record is held in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.store import new_dir, staged

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a read past its end, and of a decoded candidate's start that must hold the header's first line.
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
ID = "urn:docloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """Arrow's file system for a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """The uncompressed bytes of a response record, or of a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() else "%" + c.encode().hex() for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest page_id of an equal payload, null for that page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= least
    twice = (
        rows.where(long)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("of", "first")
    )
    joined = rows.join(twice, (F.col("digest") == F.col("of")) & long, "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = 0, level: int = 1) -> DataFrame:
    """Write an archive for each partition; return (path, bytes, records) of the files.

    A task writes to a name of its own and renames at its end; if it is run again, the same file is put in place.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own = f"{root}/.{uuid.uuid4().hex}"
        n = size = 0
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    name = base64.b32encode(bytes.fromhex(digest)).decode()
                    pack = zlib.compressobj(level, wbits=31)
                    data = pack.compress(record(page_id, url, html.encode(), name, refers_to)) + pack.flush()
                    out.write(data)
                    size += len(data)
                    n += 1
        if n:
            fs.move(own, part)
            uri = folder + "/" + part.rpartition("/")[2]
            yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size], "records": [n]})
        else:
            fs.delete_file(own)

    return staged(with_types(pages, least).mapInArrow(work, "path string, bytes bigint, records bigint"), "warc-files")


def head_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record's header and its length, if data starts with a whole one."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


class Range:
    """Members of one file that start in [start, end)."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.end, self.size, self.base = file, end, size, start
        file.seek(start)
        self.buffer = file.read(min(end + len(MAGIC) - 1, size) - start)

    def more(self) -> bool:
        data = self.file.read(READ_BYTES)
        self.buffer += data
        return bool(data)

    def members(self) -> Iterator[tuple[int, bytes]]:
        at = 0
        while True:
            at = self.buffer.find(MAGIC, at)
            if at < 0 or self.base + at >= self.end:
                return
            found = self.member(at)
            if found is None:
                at += 1
                continue
            data, length = found
            yield self.base + at, data
            at += length
            if at >= len(self.buffer) and self.base + at < self.end and not self.more():
                return

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The data and the length of the member at ``at``; None if it is none, or isn't a record."""
        unpack = zlib.decompressobj(wbits=31)
        data, fed, checked = [], at, False
        try:
            while not unpack.eof:
                if fed >= len(self.buffer) and not self.more():
                    return None
                chunk = self.buffer[fed : fed + 65536]
                data.append(unpack.decompress(chunk))
                fed += len(chunk)
                if not checked and (head := b"".join(data))[:7]:
                    if not head.startswith(b"WARC/1."[: len(head)]):
                        return None
                    checked = len(head) >= 7
        except zlib.error:
            return None
        whole = b"".join(data)
        return (whole, fed - len(unpack.unused_data) - at) if head_of(whole) else None


FIELDS = {
    "path": pa.string(),
    "offset": pa.int64(),
    "page_id": pa.int64(),
    "url": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "digest_ok": pa.bool_(),
    "payload": pa.binary(),
}
SCHEMA = "path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"


def parse(data: bytes, payloads: bool) -> tuple:
    """The values of FIELDS after path and offset. A revisit's length is that of its HTTP header; its digest is the stated one."""
    head, at = head_of(data)
    block = data[at : at + int(head["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    page = lambda v: None if v is None or v.endswith(":null>") else int(v[len(ID) + 1 : -1])
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
        size, digest, body = int(fields[b"content-length"]), stated, None
    else:
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    return page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], page(head.get("warc-refers-to")), size, digest, digest == stated, body if payloads else None


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of files(path, bytes). ``payloads`` False leaves the payload column null."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    tasks = int(files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, data in Range(file, row["start"], row["end"], row["bytes"]).members():
                        rows.append((row["path"], offset, *parse(data, payloads)))
                        held += len(data) if payloads else 400
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.repartition(tasks, "path", "start").mapInArrow(work, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FIELDS.values())], names=list(FIELDS))
