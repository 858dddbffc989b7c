"""WARC archives inside ZIP files: written by tasks, read by ranges without extraction.

A ZIP file holds one stored member with WARC records, each a gzip member of its own, and one
stored index with the place of every record.  Since members are stored, a record's place in
the ZIP file is that of the member plus its own.  The reader parses the end of the file and
the central directory (also in ZIP64 form), finds archives and indexes, and then reads every
record by its range; ranges are dealt over tasks, so one large file is read by many.

Files are opened by pyarrow's file systems, which take the folder's URI (local, HDFS, S3 ...).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored

#: Fixed values of the formats: ZIP signatures, WARC and HTTP lines.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
VERSION, HEAD = "WARC/1.1", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN, DATE = "urn:page:", "1970-01-01T00:00:00Z"
#: A ZIP file is closed when its records exceed this; bytes that one task reads in a row.
FILE_BYTES, READ_BYTES = 128 << 20, 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the digest of its payload but not the payload."""
    block = HEAD if revisit else HEAD + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}") if page_id is None else page_id
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines.append(f"WARC-Refers-To: <{URN}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _written(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write the rows of one task to ZIP files of their own names; one row per file."""
    system, path = pa.fs.FileSystem.from_uri(folder)
    rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        name, index = f"part-{uuid.uuid4().hex}.zip", []
        with system.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as archive:
            with archive.open("archive/data.warc.gz", "w", force_zip64=True) as member:
                at = 0
                while row is not None and at < file_bytes:
                    batch, i = row
                    page, url, html, refers = (batch.column(c)[i] for c in ("page_id", "url", "html", "refers_to"))
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    packed = gzip.compress(record(page.as_py(), url.as_py(), payload, refers.as_py(), refers.is_valid), 1, mtime=0)
                    member.write(packed)
                    index.append(f"{page.as_py()} {json.dumps({'offset': at, 'length': len(packed), 'filename': 'data.warc.gz'})}")
                    at += len(packed)
                    row = next(rows, None)
            archive.writestr("indexes/index.cdxj", "\n".join(index))
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])


class _Forward(io.RawIOBase):
    """A stream that is only written forward, for file systems that cannot seek back."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns path and records by file.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest
    page_id is a response and the others revisit it; smaller ones are all responses.  Null
    html is an empty payload.  Rows that repeat the largest page_id are all responses, as
    is a row without page_id in a group without any.  Files are named by the task that
    writes them, and only those of tasks that ended well are listed, so a task that runs
    again leaves no double records.
    """
    system, path = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload)).alias("one"), F.unhex(F.md5(payload)).alias("two"))
    groups = rows.groupBy("one", "two").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # only payloads that repeat are looked up, in a table of its own, so that a hot one can be split
    joined = rows.join(stored(groups, "warc-copies"), ["one", "two"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    sent = joined.select("page_id", "url", "html", F.when(revisits, F.col("first")).alias("refers_to"))
    return stored(sent.mapInArrow(lambda batches: _written(batches, folder, file_bytes), "path string, records long"), "warc-files")


def members_of(file) -> list[tuple[str, int, int, int]]:
    """Name, method, data start and stored size of the members of an open ZIP file, from its directory."""
    size = file.size()
    tail_at = max(0, size - 65_557 - 20)  # the longest comment, the end record and the ZIP64 locator
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no ZIP file: it has no end record")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20: end - 16] == LOCATOR64 and (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
        where = struct.unpack_from("<Q", tail, end - 12)[0]
        last = file.read_at(56, where)
        if last[:4] != END64:
            raise ValueError("ZIP64 end record is not where its locator says")
        count, length, at = struct.unpack_from("<QQQ", last, 32)
    directory, here, out = file.read_at(length, at), 0, []
    for _ in range(count):
        if directory[here: here + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, here + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, here + 20)
        start, = struct.unpack_from("<I", directory, here + 42)
        name = directory[here + 46: here + 46 + n_name].decode()
        extra, wide = directory[here + 46 + n_name: here + 46 + n_name + n_extra], []
        while len(extra) >= 4:  # the ZIP64 field has those of the three values that do not fit, in this order
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            extra = extra[4 + n:]
        plain, packed, start = (wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (plain, packed, start))
        local = file.read_at(30, start)
        if local[:4] != LOCAL:
            raise ValueError(f"member {name} is not where the directory says")
        out.append((name, method, start + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
        here += 46 + n_name + n_extra + n_note
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and length of every record of the listed files."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = pa.fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as file:
                members = [m for m in members_of(file) if m[1] == 0]
                starts = {name.rsplit("/", 1)[-1]: (at, size) for name, _, at, size in members if name.endswith((".warc.gz", ".warc"))}
                found, indexed = [], set()
                for name, _, at, size in members:
                    if name.endswith(".cdxj"):
                        for line in file.read_at(size, at).decode().splitlines():
                            entry = json.loads(line[line.index("{"):])
                            found.append((starts[entry["filename"]][0] + int(entry["offset"]), int(entry["length"])))
                            indexed.add(entry["filename"])
                for name in starts.keys() - indexed:
                    if name.endswith(".gz"):
                        found += _walked(file, *starts[name])
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()),
                                       pa.array([x[1] for x in found], pa.int64())], names=["path", "at", "length"])


def _walked(file, at: int, size: int) -> list[tuple[int, int]]:
    """Places and lengths of the gzip members of an archive without index."""
    out, start, here, unpack = [], at, at, zlib.decompressobj(31)
    while here < at + size:
        chunk = file.read_at(min(1 << 20, at + size - here), here)
        here += len(chunk)
        while chunk:
            unpack.decompress(chunk)
            chunk = unpack.unused_data
            if unpack.eof:
                out.append((start, here - len(chunk) - start))
                start, unpack = here - len(chunk), zlib.decompressobj(31)
    return out


def parse(data: bytes) -> dict:
    """Headers (names lower-cased) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return {"headers": headers, "block": rest[: int(headers["content-length"])]}


def _number(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(URN)
    return int(text) if text.lstrip("-").isdigit() else None


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Read, unpack and parse the records of the given ranges."""
    opened: dict[str, object] = {}
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            rows = []
            for path, at, length in zip(*(batch.column(c).slice(part, 500).to_pylist() for c in ("path", "at", "length"))):
                if path not in opened:
                    for file in opened.values():
                        file.close()
                    system, inner = pa.fs.FileSystem.from_uri(path)
                    opened = {path: system.open_input_file(inner)}
                data = opened[path].read_at(length, at)
                got = parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                headers, kind = got["headers"], got["headers"].get("warc-type")
                payload = got["block"].partition(b"\r\n\r\n")[2] if kind == "response" else None
                declared = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if payload is not None and declared not in (None, digest(payload)):
                    raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
                rows.append((_number(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, declared,
                             None if payload is None else len(payload), _number(headers.get("warc-refers-to")), payload if payloads else None))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=RECORD.replace(",", "").split()[::2])


RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the ZIP files listed in ``path``: RECORD's columns, payload null for revisits or if not asked for.

    A payload that does not have the digest of its header is an error.  A revisit has the
    payload_bytes of the response it refers to, null if that is not among the files.
    """
    ranges = files.select("path").distinct().mapInArrow(_ranges, "path string, at long, length long")
    # a number of tasks of its own: ranges are few bytes, but what they name is not
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(tasks, "path", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("path", "at")
    records = dealt.mapInArrow(lambda batches: _records(batches, payloads), RECORD)
    known = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest")).agg(
        F.max("payload_bytes").alias("r_bytes"))
    joined = records.join(known, (records["refers_to"] == known["r_page"]) & (records["payload_digest"] == known["r_digest"]), "left")
    return joined.select(*[F.coalesce("payload_bytes", "r_bytes").alias(c) if c == "payload_bytes" else records[c] for c in records.columns])


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to a new folder below the shared one and read the records back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc")), payloads)
