"""Web archives in ZIP packages: written as stored members with an index, read back by ranges.

A package holds `archive/data.warc.gz`, one gzip member for each WARC record, and
`indexes/index.cdxj`, which gives place and length of each record. Both are stored, not deflated.
Reading parses the end of the file (with ZIP64), then the central directory, then the index, and
then only the ranges of records; nothing is extracted. Python tasks write and read packages through
pyarrow's file systems, in the shared folder of the cluster; rows of pages stay in Spark.

Each task writes its packages under new names and returns them; that table is written out, so
packages of lost or repeated attempts are never referred to.

Rows of pages: a null html is an empty payload. Of equal payloads the smallest page_id is the
response and all others revisit it; rows that share this page_id are all responses. A page without
id revisits if any page with an id has its payload, else it is a response. A null url is written as
"-" and read as null. Other columns are not read. An empty table gives no packages and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.session import fresh_dir, stage

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes after which a task starts another package; pages have no times of their own.
PACKAGE_BYTES, DATE = 64 << 20, "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32, LONGEST_COMMENT = 0xFFFF, 0xFFFFFFFF, 0xFFFF


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "-") else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or a revisit, which keeps the headers of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '-').split()) or '-'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(data: bytes) -> dict:
    """Page id, url, payload and what the headers say of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    headers = headers_of(lines)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    length = int(headers_of(http.split(b"\r\n")[1:]).get("content-length", len(payload))) if revisit else len(payload)
    uri = headers.get("warc-target-uri")
    return {
        "page_id": page_of(headers.get("warc-record-id")), "url": None if uri == "-" else uri, "payload": None if revisit else payload,
        "payload_bytes": length, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(payload),
        "declared_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "record_type": headers["warc-type"],
        "refers_to": page_of(headers.get("warc-refers-to")),
    }


class Package:
    """A package being written: records go out at once, index lines at the end."""

    def __init__(self, path: str):
        self.path, self.lines, self.size = path, [], 0
        system, place = file_system(path)
        self.stream = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        data = gzip.compress(warc_record(page_id, url, payload, refers_to), 6, mtime=0)
        self.member.write(data)
        place = {"url": url, "filename": ARCHIVE, "offset": self.size, "length": len(data)}
        self.lines.append(f"{' '.join((url or '-').split()) or '-'} {DATE} {json.dumps(place)}")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)) + "\n")
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of records (page_id, url, payload, refers_to) under `folder`: (path, n_records, n_bytes)."""
    source = records.select("page_id", "url", "payload", "refers_to")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py())
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return stage(source.mapInArrow(run, "path string, n_records bigint, n_bytes bigint"), "packages")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): payloads of `least_bytes` or more that occurred before refer to the smallest id."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("hash", F.sha1("payload"))
    keys = rows.filter(F.length("payload") >= least_bytes).select("page_id", "hash")
    first = keys.groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Only ids of revisits meet the pages again, so that pages are not shuffled where revisits are few.
    known = stage(keys.join(first, "hash").filter("page_id IS NULL OR page_id > first").select(
        F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), "hash", F.col("first").alias("refers_to")).distinct(), "revisits")
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63))))
    return rows.join(known, ["key", "hash"], "left").select("page_id", "url", "payload", "refers_to")


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header: int


class Ranges:
    """A file that is read by ranges."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) < length:
            raise ValueError(f"the file ends before byte {start + length}")
        return data

    def close(self) -> None:
        self.file.close()


def directory(file: Ranges) -> list[Member]:
    """Members from the central directory, which the end of the file points to, with ZIP64 where it is used."""
    tail_at = max(0, file.size - 22 - LONGEST_COMMENT - 20)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)  # the mark may also stand in a comment
    if end < 0:
        raise ValueError("no ZIP directory at the end")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20: end - 16] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = file.read(at, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 directory where the locator points")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    data, at, out = file.read(start, size), 0, []
    for _ in range(count):
        if data[at: at + 4] != ENTRY:
            raise ValueError("the central directory is broken")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        flags, = struct.unpack_from("<H", data, at + 8)
        name = data[at + 46: at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, stop = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= stop:
            kind, length = struct.unpack_from("<HH", data, extra)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                place = extra + 4
                if plain == FULL32:
                    plain, = struct.unpack_from("<Q", data, place)
                    place += 8
                if packed == FULL32:
                    packed, = struct.unpack_from("<Q", data, place)
                    place += 8
                if header == FULL32:
                    header, = struct.unpack_from("<Q", data, place)
            extra += 4 + length
        out.append(Member(name, method == 0, packed, header))
        at = stop + n_comment
    return out


def data_start(file: Ranges, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed in its package and can't be read by ranges")
    head = file.read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no header of {member.name} where the directory points")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def record_ranges(file: Ranges) -> list[tuple[int, int]]:
    """(start, length) in the package of every record that its indexes name, in order."""
    members, out = {m.name: m for m in directory(file)}, []
    for name in sorted(members):
        if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj")):
            text = file.read(data_start(file, members[name]), members[name].size).decode()
            starts: dict[str, int] = {}
            for line in text.splitlines():
                if not line.strip() or line.startswith("!"):
                    continue
                place = json.loads(line[line.index("{"):])
                archive = place["filename"] if place["filename"] in members else f"archive/{place['filename']}"
                if archive not in starts:
                    starts[archive] = data_start(file, members[archive])
                out.append((starts[archive] + int(place["offset"]), int(place["length"])))
    return sorted(out)


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean, payload binary"


#: Bytes of records, as stored, that are dealt together.
CHUNK = 8 << 20


def range_chunks(paths: DataFrame, tasks: int, chunk: int = CHUNK) -> DataFrame:
    """(path, first, starts, lengths): the records of each package in runs of about `chunk` bytes, from its indexes alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file = Ranges(path)
                ranges = record_ranges(file)
                file.close()
                cuts, held = [0], 0
                for i, (_, length) in enumerate(ranges):
                    if held and held + length > chunk:
                        cuts.append(i)
                        held = 0
                    held += length
                parts = [ranges[a:b] for a, b in zip(cuts, [*cuts[1:], len(ranges)], strict=True) if b > a]
                yield pa.record_batch([
                    pa.array([path] * len(parts)), pa.array([p[0][0] for p in parts], pa.int64()),
                    *(pa.array([[r[k] for r in p] for p in parts], pa.list_(pa.int64())) for k in (0, 1)),
                ], names=["path", "first", "starts", "lengths"])

    # Ranges of paths, so that each of few packages meets a task of its own.
    return paths.select("path").repartitionByRange(tasks, "path").mapInArrow(run, "path string, first bigint, starts array<bigint>, lengths array<bigint>")


def read_packages(paths: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """A row (RECORD) for each record of the packages in column `path`; `intact`: the digest is that of the payload.

    Runs of records, of one package or many, are dealt to `tasks` tasks (by default as many as shuffles have).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, rows, held = Ranges(path), [], 0
                for start, length in zip(starts, lengths, strict=True):
                    got = parse_record(gzip.decompress(file.read(start, length)))
                    got["intact"] = got["payload_digest"] == got.pop("declared_digest")
                    held += len(got["payload"] or b"")
                    got["payload"] = got["payload"] if payloads else None
                    rows.append(got)
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield to_batch(rows)
                        rows, held = [], 0
                file.close()
                if rows:
                    yield to_batch(rows)

    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in RECORD.split(", ")]

    def to_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    tasks = tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return range_chunks(paths, tasks).repartitionByRange(tasks, "path", "first").mapInArrow(run, RECORD)


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the packages in a folder."""
    system, place = file_system(folder)
    found = [f for f in system.get_file_info(pa.fs.FileSelector(place)) if f.base_name.endswith((".wacz", ".zip"))]
    return spark.createDataFrame([(f"{folder}/{f.base_name}",) for f in found], "path string")


def op2_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(with_revisits(pages), fresh_dir(spark, "warc"))
    return read_packages(packages, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


#: Base 32 from hexadecimal digits: five of them are four letters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (i // 4 * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS intact
FROM p JOIN f USING (hex)
"""
