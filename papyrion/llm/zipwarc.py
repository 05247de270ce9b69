"""WARC archives packaged in ZIP files, read by ranges.

A package is a ZIP file of stored members in the shared folder: an archive of WARC records, each a
gzip member of its own, and an index with one line for each record (page, offset, length). The
reader takes anything that gives bytes by offset and length: it finds the end record, follows the ZIP64 locator
where there is one, parses the central directory with its ZIP64 extra fields, locates the stored
members, reads the index and then each record by its own range. Nothing is extracted.

Pages with equal payloads are written once: the record with the smallest page_id is a response,
the others are revisits that name it. Payloads move only with rows that may be a response, the
smallest ids so far of their payload in their partition; the other rows move with a digest alone.

Defined edge cases: a null html is the empty payload; repeated pages are written each; rows with
a null page_id are responses of their own; line breaks in urls are escaped; extra columns are
ignored; an empty table gives an empty result. A task that is run again writes packages of other
names, and only those of the run that counts are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 -- pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, shared_dir, tidy

#: Payload bytes after which a package is closed.
PACKAGE_BYTES = 4_000_000
#: Package bytes that one reading task is given, unless there are cores to spare.
READ_BYTES = 128_000_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


class Range:
    """Bytes by offset and length; counts what is read."""

    def __init__(self, data):
        self.data, self.size, self.read_bytes = memoryview(data), len(data), 0

    def read(self, offset: int, length: int) -> bytes:
        self.read_bytes += length
        return bytes(self.data[offset : offset + length])


class FileRange(Range):
    """The same over an open seekable file."""

    def __init__(self, file):
        self.file, self.read_bytes = file, 0
        file.seek(0, io.SEEK_END)
        self.size = file.tell()

    def read(self, offset: int, length: int) -> bytes:
        self.read_bytes += length
        self.file.seek(offset)
        return self.file.read(length)


def directory(source: Range) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its data, length) of every stored member."""
    tail_at = max(0, source.size - 65_557)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        wide = source.read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        entries, size, start = struct.unpack_from("<QQQ", wide, 32)
    central, at, out = source.read(start, size), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", central, at + 20)
        (local,) = struct.unpack_from("<I", central, at + 42)
        name = central[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = source.read(local, 30)
            n_name2, n_extra2 = struct.unpack_from("<HH", head, 26)
            out[name] = (local + 30 + n_name2 + n_extra2, packed)
        at += 46 + n_name + n_extra + n_note
    return out


def index(source: Range, members: dict | None = None) -> list[tuple[int, int]]:
    """(offset, length) in the archive of every record, from the stored index."""
    at, n = (members or directory(source))[INDEX]
    lines = source.read(at, n).decode().splitlines()
    return [(int(p[1]), int(p[2])) for p in map(str.split, lines)]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, packed or plain."""
    if record[:2] == b"\x1f\x8b":
        record = gzip.decompress(record)
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, record[end + 4 : end + 4 + int(headers["content-length"])]


def records(source: Range) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every indexed record, each by a range of its own."""
    members = directory(source)
    base, _ = members[ARCHIVE]
    for offset, length in index(source, members):
        yield parse(source.read(base + offset, length))


def record(page_id, url: str, payload: bytes | None, digest: str, refers_to, size: int | None = None) -> bytes:
    """A WARC record: the payload in a response, none (its ``size`` is enough) in a revisit."""
    url = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if url and ("\r" in url or "\n" in url) else url or ""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload) if size is None else size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(rows: list[tuple[object, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with the records and their index as stored members."""
    out, lines, at = io.BytesIO(), [], 0
    for page_id, data in rows:
        lines.append(f"{page_id} {at} {len(data)}")
        at += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(d for _, d in rows)), (INDEX, "\n".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def opened(uri: str):
    """The file system of a uri and the path in it; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def lean(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, payload) with digest and size; the payload is null where a row of the partition before it has a smaller id and the same payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            digests, sizes, keep = [], [], []
            for page, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                data = payload.as_buffer()
                key = hashlib.sha1(data).digest()
                digests.append(key)
                sizes.append(data.size)
                keep.append(page is None or page <= least.get(key, page))
                if page is not None and page <= least.get(key, page):
                    least[key] = page
            payload = pa.compute.if_else(pa.array(keep, pa.bool_()), batch.column(2), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), payload, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["page_id", "url", "payload", "digest", "size"])

    return rows.mapInArrow(tidy(run), "page_id long, url string, payload binary, digest binary, size long")


def write(pages: DataFrame, package_bytes: int = PACKAGE_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write packages that hold a record for every row of ``pages`` into the shared folder: name (a uri), size, records.

    Payloads under ``least_bytes`` are responses each.
    """
    folder = f"{shared_dir(pages.sparkSession)}/papyrion-{uuid.uuid4().hex}/packages"
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    p = materialise(lean(p), "lean", compression="zstd")
    large = p.where(F.col("size") >= least_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when((F.col("size") >= least_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    # a page that refers to another needs no payload
    rows = p.join(first, "digest", "left").withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        held, size = [], 0

        def close():
            name, content = f"{uuid.uuid4().hex}.zip", package(held)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(content)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(content)], pa.int64()), pa.array([len(held)], pa.int64())], ["name", "size", "records"])

        for batch in batches:
            for page, url, payload, digest, length, refers in zip(*(batch.column(k) for k in range(6))):
                page, digest = page.as_py(), base64.b32encode(digest.as_py()).decode()
                data = gzip.compress(record(page, url.as_py(), payload.as_py(), digest, refers.as_py(), length.as_py()), 3, mtime=0)
                held.append((page, data))
                size += len(data)
                if size >= package_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    names = materialise(rows.mapInArrow(tidy(run), "name string, size long, records long"), "names")
    release(p)
    return names


def read(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload) of every record of the packages (name, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if (x := v.split(":")[-1].rstrip(">")) == "None" else int(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)][: 5 + with_payload], names[: 5 + with_payload])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = opened(name)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                with store.open_input_file(path) as file:
                    for head, block in records(FileRange(file)):
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        response = head["warc-type"] == "response"
                        if response:
                            # what is reported of a response is what was read
                            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        refers = head.get("warc-refers-to")
                        row = (number(head["warc-record-id"]), len(block) if response else int(head["warc-payload-length"]), digest, head["warc-type"], number(refers) if refers else None, block if with_payload else None)
                        for column, v in zip(out, row):
                            column.append(v)
                yield made(out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    n, size = packages.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, min(n, packages.sparkSession.sparkContext.defaultParallelism), math.ceil((size or 0) / READ_BYTES))
    return packages.select("name").repartition(tasks, "name").mapInArrow(tidy(run), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the packages into the shared folder and read every record back."""
    return read(write(pages), with_payload=False)
