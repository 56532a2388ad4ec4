"""WARC archives in ZIP packages, read by ranges.

A package holds stored members: a WARC file whose records are gzip members, and
its CDX index. The reader parses the end record, the ZIP64 locator and the central
directory from the tail of a package, finds the stored members and indexes, and
then range-reads records; no member is extracted. Files are reached with pyarrow's
file systems, by the path's scheme.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows
from newsloom.sources.workspace import new_path, write_through

# Equal payloads of this size and more are stored once.
REVISIT_FROM_BYTES = 0
# A package is closed when its WARC member has this size.
PACKAGE_BYTES = 256 * 1024 * 1024
# Records of a package that one reading task gets, by the bytes they span.
SLICE_BYTES = 64 * 1024 * 1024
# Adjacent records are read together up to this size.
READ_BYTES = 4 * 1024 * 1024
WARC_DATE = "1970-01-01T00:00:00Z"
CDX_HEAD = " CDX N b a m s k r M S V g\n"
_PAGE_URN = "urn:page:"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing ---------------------------------------------------------------


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_PAGE_URN}{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """One ZIP package: a WARC member, then the index member."""

    def __init__(self, stream, name: str):
        self.name = name
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(f"{name}.warc.gz", "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id, url: str | None, payload: bytes, refers_to) -> None:
        url = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~") or "-"
        digest = payload_digest(payload)
        data = gzip.compress(_record(page_id, url, payload, digest, refers_to), 1, mtime=0)
        kind = "text/html" if refers_to is None else "warc/revisit"
        self.index.append(f"{url} 19700101000000 {url} {kind} 200 {digest} - - {len(data)} {self.size} {self.name}.warc.gz\n")
        self.member.write(data)
        self.size += len(data)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(f"{self.name}.cdx", CDX_HEAD + "".join(self.index))
        self.zip.close()
        return len(self.index)


def write_packages(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM_BYTES,
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns path and records per package.

    Of records with equal payloads of at least ``revisit_from`` bytes that with the largest
    page id is the response and the others revisit it; rows that repeat this id are responses
    too, and a row without an id is one only if no equal payload has an id. A null html is
    the empty payload. Each try of a task writes files of its own; only those of the try that
    ended well are in the result, so a lost executor leaves no half package in it.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    equal = (
        rows.filter(F.octet_length("html") >= revisit_from).groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    placed = rows.join(equal, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)

    def written(batches):
        fs, base = file_system(folder)
        writer = stream = path = None

        def closed():
            n = writer.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = uuid.uuid4().hex
                    path = f"{folder.rstrip('/')}/{name}.zip"
                    stream = fs.open_output_stream(f"{base.rstrip('/')}/{name}.zip")
                    writer = PackageWriter(stream, name)
                writer.add(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                if writer.size >= package_bytes:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return placed.mapInArrow(written, "path string, records bigint")


# -- the directory of a package ---------------------------------------------

# Fixed values of the ZIP format: signatures.
END, END_64, LOCATOR_64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ALL_32, _ALL_16 = 0xFFFFFFFF, 0xFFFF


def _at(file, offset: int, size: int) -> bytes:
    """Bytes of a pyarrow random-access file."""
    return file.read_at(size, offset)


def central_directory(file) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory, from ZIP64 records where there are."""
    total = file.size()
    tail_size = min(total, 22 + _ALL_16 + 20)
    tail = _at(file, total - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR_64:
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        record = _at(file, where, 56)
        if record[:4] != END_64:
            raise ValueError("ZIP64 locator points to no ZIP64 end record")
        entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, size, entries


def members(file) -> Iterator[dict]:
    """Members of a package: name, method, size, compressed size, and where their data begin."""
    offset, size, entries = central_directory(file)
    directory, at = _at(file, offset, size), 0
    for _ in range(entries):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                # The 8-byte values stand only for those that are all ones above, in this order.
                big, read = extra[4 : 4 + n], 0
                if plain == _ALL_32:
                    (plain,), read = struct.unpack_from("<Q", big, read), read + 8
                if packed == _ALL_32:
                    (packed,), read = struct.unpack_from("<Q", big, read), read + 8
                if local == _ALL_32:
                    (local,) = struct.unpack_from("<Q", big, read)
            extra = extra[4 + n :]
        head = _at(file, local, 30)
        if head[:4] != LOCAL:
            raise ValueError("a directory entry points to no local header")
        skip = sum(struct.unpack_from("<HH", head, 26))
        yield {"name": name, "method": method, "size": plain, "packed": packed, "data": local + 30 + skip}
        at += 46 + n_name + n_extra + n_comment


# -- records ----------------------------------------------------------------


def _index_ranges(file, index: dict, archives: dict[str, dict]) -> Iterator[tuple[int, int]]:
    """Ranges of the records an index member names, read in pieces."""
    rest, at, end = b"", index["data"], index["data"] + index["size"]
    while at < end or rest:
        piece = _at(file, at, min(READ_BYTES, end - at)) if at < end else b""
        at += len(piece)
        lines = (rest + piece).split(b"\n")
        rest = lines.pop() if at < end else b""
        for line in lines:
            fields = line.split(b" ")
            if line.startswith(b" CDX") or len(fields) < 11:
                continue
            archive = archives.get(fields[10].decode())
            if archive:
                yield archive["data"] + int(fields[9]), int(fields[8])


def _scanned_ranges(file, archive: dict) -> Iterator[tuple[int, int]]:
    """Ranges of the records of an archive member without an index, by reading it through."""
    at, end = archive["data"], archive["data"] + archive["size"]
    while at < end:
        start = at
        if archive["name"].endswith(".gz"):
            unpack = zlib.decompressobj(31)
            while not unpack.eof:
                piece = _at(file, at, min(READ_BYTES, end - at))
                if not piece:
                    raise ValueError("a gzip member of an archive is cut off")
                unpack.decompress(piece)
                at += len(piece) - len(unpack.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                piece = _at(file, start + len(head), min(65536, end - start - len(head)))
                if not piece:
                    return
                head += piece
            head = head[: head.index(b"\r\n\r\n") + 4]
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            if not length:
                raise ValueError("a WARC record without Content-Length")
            at = start + len(head) + int(length[1]) + 4
        yield start, at - start


def record_ranges(file) -> Iterator[tuple[int, int, bool]]:
    """Offset, length and compression of each record of a package."""
    stored = [m for m in members(file) if m["method"] == 0]
    archives = {m["name"]: m for m in stored if re.search(r"\.warc(\.gz)?$", m["name"])}
    indexed = set()
    for m in stored:
        if m["name"].endswith(".cdx"):
            stem = m["name"][:-4]
            own = {n: a for n, a in archives.items() if n in (f"{stem}.warc.gz", f"{stem}.warc")}
            indexed |= own.keys()
            for name, archive in own.items():
                for start, length in _index_ranges(file, m, {name: archive}):
                    yield start, length, name.endswith(".gz")
    for name in archives.keys() - indexed:
        for start, length in _scanned_ranges(file, archives[name]):
            yield start, length, name.endswith(".gz")


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{_PAGE_URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload, payload_bytes and payload_digest of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = _headers(top)
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": _page_of(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type")}
    if out["record_type"] == "revisit":
        return out | {
            "refers_to": _page_of(head.get("warc-refers-to")), "payload": None,
            "payload_bytes": int(_headers(http)["content-length"]),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
        }
    return out | {"refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": payload_digest(payload)}


RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"
)
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def read_packages(packages: DataFrame, with_payload: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Records of the packages named in the column ``path``.

    First each package's directory and indexes give the ranges of its records, then the
    ranges are dealt out by package and slice and read. Members that are not stored, and
    members other than archives and indexes, are left out; an archive member without an
    index is read through for its ranges. A revisit has no payload; its size is the one
    its HTTP head names. A package without records gives no rows, a broken one an error.
    """

    def ranges(batch: pa.RecordBatch):
        for path in batch.column(0).to_pylist():
            fs, inner = file_system(path)
            found: list[tuple] = []
            with fs.open_input_file(inner) as file:
                for one in record_ranges(file):
                    found.append(one)
                    if len(found) == 50_000:
                        yield _ranges_batch(path, found)
                        found = []
            yield _ranges_batch(path, found)

    def records(batch: pa.RecordBatch):
        rows, out, size, path, file = batch.to_pylist(), [], 0, None, None
        at = 0
        while at < len(rows):
            if rows[at]["path"] != path:
                path = rows[at]["path"]
                fs, inner = file_system(path)
                file = fs.open_input_file(inner)
            end, start = at + 1, rows[at]["offset"]
            stop = start + rows[at]["length"]
            while (end < len(rows) and rows[end]["path"] == path and rows[end]["offset"] == stop
                   and stop + rows[end]["length"] - start <= READ_BYTES):
                stop += rows[end]["length"]
                end += 1
            data = _at(file, start, stop - start)
            for r in rows[at:end]:
                raw = data[r["offset"] - start : r["offset"] - start + r["length"]]
                record = parse_record(gzip.decompress(raw) if r["packed"] else raw)
                size += len(record["payload"] or b"")
                if not with_payload:
                    record["payload"] = None
                out.append(record)
            at = end
            if size > 8 * READ_BYTES:
                yield pa.RecordBatch.from_pylist(out, _RECORD)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, _RECORD)

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = map_rows(
        packages.select("path").repartition(parts, "path"), ranges, "path string, offset bigint, length bigint, packed boolean"
    )
    dealt = listed.withColumn("slice", F.floor(F.col("offset") / slice_bytes)).repartition(parts, "path", "slice")
    return map_rows(dealt.sortWithinPartitions("path", "offset").drop("slice"), records, RECORD_SCHEMA)


def _ranges_batch(path: str, found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
        pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_()),
    ], ["path", "offset", "length", "packed"])


def round_trip(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read the records back."""
    folder = new_path(pages.sparkSession, "packages")
    packages = write_through(write_packages(pages, folder, **options), "package-list")
    return read_packages(packages, with_payload)
