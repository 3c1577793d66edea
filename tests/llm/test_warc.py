import gzip
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gatewright.llm.warc_zip import (
    ARCHIVE, Ranges, data_start, digest, directory, list_packages, parse_record, range_chunks, read_packages, record_ranges, warc_record,
    with_revisits, write_packages,
)

from gatewright.session import fresh_dir


def test_round_trip(spark, tmp_path):
    big = "x" * 200_000 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a/ b", "same"), (1, None, "same"), (2, "u", None), (9, "u", ""), (4, "", big), (5, "v", big), (None, "n", "same"),
            (None, "n", "only"), (7, "w", "rep"), (7, "w", "rep"), (8, "w", "other")]
    pages = spark.createDataFrame([(*r, "k", 5) for r in rows], "page_id bigint, url string, html string, hash string, key int")
    for size in (1, 1 << 20):
        folder = f"file://{tmp_path}/p{size}"
        made = write_packages(with_revisits(pages), folder, size)
        assert sum(r.n_records for r in made.collect()) == len(rows)
        for paths in (made, list_packages(spark, folder)):
            got = read_packages(paths).collect()
            assert all(r.intact for r in got)
            want = []
            for page, url, html in rows:
                same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
                first = min(same, default=None)
                refers = first if first is not None and page != first else None
                data = (html or "").encode()
                want.append((page, " ".join(url.split()) if url else None, len(data), digest(data), "revisit" if refers is not None else "response",
                             refers, None if refers is not None else data))
            key = lambda r: tuple(map(str, r))
            have = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                     None if r.payload is None else bytes(r.payload)) for r in got]
            assert sorted(have, key=key) == sorted(want, key=key)
    assert {r.refers_to for r in with_revisits(pages, least_bytes=5).collect()} == {None, 4}
    assert read_packages(write_packages(with_revisits(pages.limit(0)), f"file://{tmp_path}/none")).collect() == []


def test_zip64(tmp_path):
    """More members than 16 bits count, then sizes and places that only the 64-bit fields hold."""
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr(zipfile.ZipInfo("é.txt"), b"found")
        z.comment = b"PK\x05\x06 is no end" + b"." * 30
    file = Ranges(str(path))
    members = directory(file)
    assert len(members) == 66_001 and members[-1].name == "é.txt"
    assert file.read(data_start(file, members[-1]), members[-1].size) == b"found"
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 4 + 4 + 28, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += b"x" + struct.pack("<HHHHQQQ", 99, 0, 1, 24, 7 << 32, 7 << 32, 5 << 32)
    entry += b"\0" * 4  # padding of the extra field
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(entry + end64 + locator + end)
    only, = directory(Ranges(str(path)))
    assert (only.name, only.size, only.header, only.stored) == ("x", 7 << 32, 5 << 32, True)


def test_foreign_package(tmp_path):
    """Bare file names in the index, several archives, and what can't be read."""
    records = [gzip.compress(warc_record(i, "u", b"p" * i, None)) for i in range(4)]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("archive/a.warc.gz", records[0] + records[1])
        z.writestr("archive/b.warc.gz", records[2] + records[3])
        line = 'k 2024 {"filename": "%s", "offset": "%d", "length": "%d"}\n'
        z.writestr("indexes/x.cdxj", "!meta\n\n" + line % ("a.warc.gz", len(records[0]), len(records[1])) + line % ("archive/b.warc.gz", 0, len(records[2])))
    path = tmp_path / "f.wacz"
    path.write_bytes(made.getvalue())
    file = Ranges(str(path))
    assert [parse_record(gzip.decompress(file.read(*r)))["page_id"] for r in record_ranges(file)] == [1, 2]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(ARCHIVE, b"a" * 99)
    file = Ranges(str(path))
    with pytest.raises(ValueError):
        data_start(file, directory(file)[0])
    path.write_bytes(b"short")
    with pytest.raises(ValueError):
        directory(Ranges(str(path)))


def test_reading_is_spread(spark):
    """k packages meet min(k, n) tasks; a large one is cut into runs of records."""
    pages = spark.range(600).selectExpr("id as page_id", "concat('u', id) as url", "repeat(uuid(), 30) as html")
    packages = write_packages(with_revisits(pages), fresh_dir(spark, "spread"), 20_000)
    k = packages.count()
    assert k >= 8
    for n in (5, 4 * k):
        parts = [r.p for r in read_packages(packages, tasks=n).select("page_id", F.spark_partition_id().alias("p")).collect()]
        assert len(parts) == 600 and len(set(parts)) == min(k, n)
    whole = write_packages(with_revisits(pages).coalesce(1), fresh_dir(spark, "spread"), 1 << 30)
    chunks = range_chunks(whole, 4, 10_000).collect()
    assert len(chunks) > 3 * whole.count() and sum(len(r.starts) for r in chunks) == 600
