"""Web archives in ZIP packages: written in parallel, read by ranges.

A package holds two stored (uncompressed) members: `archive/data.warc.gz`, WARC
records that are gzip members of their own, and `indexes/index.cdxj`, one JSON
line for each record with its offset and length. The reader parses the end
record, the ZIP64 records and the central directory, finds stored members and
the index, and reads each record by its range; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import slices
from brightledger.llm.tables import settled
from brightledger.session import work_folder

#: A package is closed once its records have this many bytes.
PACKAGE_BYTES = 16 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# --- ZIP ---------------------------------------------------------------------

_U16, _U32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


def stored_zip(members: Iterable[tuple[str, bytes]]) -> bytes:
    """A ZIP of stored members with ZIP64 sizes, offsets and end record."""
    out, directory, n = io.BytesIO(), io.BytesIO(), 0
    for name, data in members:
        at, raw, crc = out.tell(), name.encode(), zlib.crc32(data)
        sizes = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, _U32, _U32, len(raw), len(sizes)) + raw + sizes)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory.write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, _U32, _U32, len(raw), len(extra), 0, 0, 0, 0, _U32) + raw + extra)
        n += 1
    start, listing = out.tell(), directory.getvalue()
    end = start + len(listing)
    out.write(listing)
    out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listing), start))
    out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _U16, _U16, _U32, _U32, 0))
    return out.getvalue()


def _at(file: BinaryIO, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError("the archive is cut off")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """The members by the central directory, with ZIP64 fields where given.
    Raises ValueError if there is no end record or a part is cut off."""
    tail_at = max(0, size - 22 - _U16)
    tail = _at(file, tail_at, size - tail_at)
    found = len(tail)
    while True:  # the comment of the end record may hold its signature
        found = tail.rfind(b"PK\5\6", 0, found)
        if found < 0:
            raise ValueError("no end record of a ZIP")
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<H2I", tail, found + 10)
    end_at = tail_at + found
    if end_at >= 20 and (locator := _at(file, end_at - 20, 20))[:4] == b"PK\6\7":
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, start = struct.unpack_from("<3Q", record, 32)
    data, at, members = _at(file, start, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", data, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, e)
            if kind == 1:  # only the fields that don't fit are given, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == _U32 else plain
                packed = next(wide) if packed == _U32 else packed
                header = next(wide) if header == _U32 else header
            e += 4 + n
        members.append(Member(name, method, plain, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(file: BinaryIO, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    local = _at(file, member.header_at, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError("no local header where the directory points")
    return member.header_at + 30 + sum(struct.unpack_from("<2H", local, 26))


# --- WARC --------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or with payload None a revisit
    record, which keeps the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = {"WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": _name(page_id), "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = json.dumps(url)[1:-1]  # no line ends in a header
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if payload is None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _name(refers_to)}
    body = http + (payload or b"")
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(body))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers (names in lower case), and the payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {p[0].lower(): p[-1] for p in pairs}


# --- Spark -------------------------------------------------------------------

_MANIFEST = "path string, records long, bytes long"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_at long"


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_payload: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record for each row into ZIP packages below `folder` (a shared
    folder; one below `spark.checkpoint.dir` by default). Returns the manifest:
    path, records, bytes of each package.

    Of rows whose equal payloads have at least `min_payload` bytes, that with
    the largest id is a response and the others are revisits; rows that share
    that id are all responses. Null html is an empty payload. Payloads travel
    as compressed records. Packages of lost tasks are written again under
    another name; the manifest names only those that count.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "archives")
    key = F.sha1(F.coalesce(F.col(html_column), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce(F.col(html_column), F.lit("")))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), key.alias("key"))
    repeated = pages.where(size >= min_payload).groupBy(key.alias("key")).agg(F.max(F.col(id_column).cast("long")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = settled(repeated.where("n > 1").drop("n"), "repeated")

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["key"])).decode()
                out.append((row["page_id"], row["url"], row["key"], len(payload), record(row["page_id"], row["url"], payload, len(payload), digest, None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["page_id", "url", "key", "size", "member"])

    members = rows.mapInArrow(compressed, "page_id long, url string, key string, size long, member binary")
    dealt = members.join(repeated, "key", "left").select("page_id", "url", "key", "size", F.when(F.col("page_id") != F.col("keeper"), None).otherwise(F.col("member")).alias("member"), "keeper")

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            path = f"{uuid.uuid4().hex}.wacz"
            whole = stored_zip([(ARCHIVE, data.getvalue()), (INDEX, "".join(index).encode())])
            with store.open_output_stream(f"{base}/{path}") as out:
                out.write(whole)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([len(whole)], pa.int64())})
            data.seek(0)
            data.truncate()
            index.clear()
            return done

        for batch in slices(batches, "member"):
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["key"])).decode()
                member = row["member"]
                if member is None:
                    member = record(row["page_id"], row["url"], None, row["size"], digest, row["keeper"])
                index.append(json.dumps({"id": row["page_id"], "offset": data.tell(), "length": len(member), "digest": f"sha1:{digest}"}) + "\n")
                data.write(member)
                if data.tell() >= package_bytes:
                    yield close()
        if index:
            yield close()

    return settled(dealt.mapInArrow(packages, _MANIFEST), "manifest")


def read_archives(manifest: DataFrame, batch_records: int = 1000) -> DataFrame:
    """One row for each record that the packages' indexes list: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, archive, record_at.

    Packages are spread over tasks; each record is one range read. The payload
    of a response is hashed again and must match its header; a revisit's length
    and digest are those of the full payload, from its headers.
    """
    spark = manifest.sparkSession
    packages = max(1, manifest.count())

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                size = store.get_file_info(name).size
                with store.open_input_file(name) as file:
                    members = {m.name: m for m in directory(file, size)}
                    index_at, data_at = data_start(file, members[INDEX]), data_start(file, members[ARCHIVE])
                    lines = _at(file, index_at, members[INDEX].size).splitlines()
                    for begin in range(0, len(lines), batch_records):
                        yield _rows(file, path, data_at, lines[begin : begin + batch_records])

    return manifest.select("path").repartition(min(packages, 100_000)).mapInArrow(records, _RECORDS)


def _rows(file: BinaryIO, path: str, data_at: int, lines: list[bytes]) -> pa.RecordBatch:
    columns: dict[str, list] = {c.split()[0]: [] for c in _RECORDS.split(", ")}
    for line in lines:
        entry = json.loads(line)
        warc, http, payload = parse_record(_at(file, data_at + entry["offset"], entry["length"]))
        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
        if entry["digest"] != f"sha1:{digest}" or kind == "response" and payload_digest(payload) != digest:
            raise ValueError(f"digest of record {entry['offset']} in {path} differs")
        uri = warc.get("warc-target-uri")
        row = (
            _id(warc["warc-record-id"]), None if uri is None else json.loads(f'"{uri}"'), len(payload) if kind == "response" else int(http["content-length"]),
            digest, kind, _id(warc.get("warc-refers-to")), path, entry["offset"],
        )
        for column, value in zip(columns.values(), row):
            column.append(value)
    types = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) for n, t in (c.split() for c in _RECORDS.split(", "))], list(columns))
