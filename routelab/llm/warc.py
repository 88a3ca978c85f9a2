"""WARC records in ZIP-packaged archives, written and read back by byte ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj`` (a line a
record with its offset and length). The reader takes the end record and its ZIP64 forms from the file's tail, parses the central
directory, finds where a stored member's bytes begin, reads the index and then only the ranges of the records asked for.

Of records with equal payloads of at least ``least`` bytes those with the smallest page id are responses, the others revisits
that refer to it and carry no payload. Defined cases: a null html is an empty payload; rows that repeat the smallest id are all
responses; null ids come last and are responses only where no id is known; ids are bigints, others raise; payloads of any size are one
record, held whole by the task that writes or reads it; a null url is written as ``urn:unknown``. Other
columns are dropped. An empty table gives no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm import storage
from routelab.llm.common import fresh_uri, staged, tidy, utf8
from routelab.shipping import ship

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
FAR16, FAR32 = 0xFFFF, 0xFFFFFFFF
SALTS = 32

# --- ZIP -------------------------------------------------------------------------------------------------------------------


def zip_parts(members: list[tuple[str, bytes]], zip64: bool = True) -> list[bytes]:
    """A ZIP file of stored members, in parts; ``zip64`` puts sizes and offsets into ZIP64 fields even where they are small."""
    parts, directory, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= FAR32 or at >= FAR32
        shown = FAR32 if big else n
        local = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(local)) + raw + local
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, FAR32 if big else at) + raw + extra)
        parts += [head, data]
        at += len(head) + n
    listed = b"".join(directory)
    count, size = len(members), len(listed)
    end = b""
    if zip64 or count >= FAR16 or at >= FAR32:
        end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
        end += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, FAR16, FAR16, FAR32, FAR32, 0)
    else:
        end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, size, at, 0)
    return [*parts, listed, end]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


class BadZip(ValueError):
    pass


def central_directory(file: storage.RangeFile) -> list[Member]:
    """The members of a ZIP file: its tail and its directory are all that is read."""
    span = min(file.size, 22 + 20 + 0xFFFF)
    tail, base = file.read(file.size - span, span), file.size - span
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at -= 1
    if at < 0:
        raise BadZip("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if FAR16 == count or FAR32 in (size, offset):
        locator = tail[at - 20 : at] if at >= 20 else file.read(base + at - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise BadZip("no ZIP64 locator")
        record = file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise BadZip("no ZIP64 end record")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = file.read(offset, size), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise BadZip("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name]
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # holds, in this order, only the fields that are full
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == FAR32 else plain
                packed = wide.pop(0) if packed == FAR32 else packed
                header = wide.pop(0) if header == FAR32 else header
            e += 4 + length
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, plain, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(file: storage.RangeFile, member: Member) -> int:
    """Where a stored member's bytes begin; the local header may have other extra fields than the directory."""
    if member.method != 0:
        raise BadZip(f"{member.name} isn't stored")
    head = file.read(member.header, 30)
    if head[:4] != b"PK\3\4":
        raise BadZip(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- WARC ------------------------------------------------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return None if name in ("", "none") else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has only its HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page id, kind, sizes, digest and payload of one record; a response's digest is made from its payload and checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


def decided(pages: DataFrame, least: int = 100, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page.

    Only digests that occur more than once are joined back. Payloads cross the network once.
    """
    rows = pages.select(F.col(page).cast("bigint").alias("page_id"), F.col(url).alias("url"), utf8(F.col(html)).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    first = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # One digest may be that of a third of all pages: rows of a digest are dealt to SALTS keys, each with its own copy of the short row.
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(first, ["payload_digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, archive_bytes: int = 1 << 25) -> DataFrame:
    """Write the rows of :func:`decided` to archives of about ``archive_bytes``; archive, records and bytes of each that was committed."""
    spark = rows.sparkSession
    ship(spark)
    folder = fresh_uri(spark, "warc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lines, size = [], [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            written = storage.write_bytes(uri, zip_parts([(DATA, b"".join(data)), (INDEX, "".join(lines).encode())]))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(lines)], pa.int64()), pa.array([written], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
                page_id, url, payload, n, digest, kind, refers_to = (x.as_py() for x in row)
                packed = gzip.compress(record_bytes(page_id, url, payload or b"", n, digest, kind, refers_to), 6, mtime=0)
                lines.append(f"{_urn(page_id)} 19700101000000 {json.dumps({'offset': size, 'length': len(packed), 'digest': digest})}\n")
                data.append(packed)
                size += len(packed)
                if size >= archive_bytes:
                    yield close()
                    data, lines, size = [], [], 0
        if lines:
            yield close()

    return rows.mapInArrow(tidy(run), "archive string, records bigint, bytes bigint")


def record_ranges(archives: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """archive, offset, lengths: runs of neighbouring records, from each archive's own directory and index."""
    ship(archives.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with storage.RangeFile(uri) as file:
                    members = {m.name: m for m in central_directory(file)}
                    index = members[INDEX]
                    lines = file.read(data_offset(file, index), index.size).decode().splitlines()
                    base = data_offset(file, members[DATA])
                runs: list[tuple[int, list[int]]] = []
                end = 0
                for line in lines:
                    at = json.loads(line.split(" ", 2)[2])
                    offset, length = base + at["offset"], at["length"]
                    if not runs or end != offset or end - runs[-1][0] >= range_bytes:
                        runs.append((offset, []))
                    runs[-1][1].append(length)
                    end = offset + length
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs)), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["archive", "offset", "lengths"])

    return archives.select("archive").mapInArrow(tidy(run), "archive string, offset bigint, lengths array<bigint>")


def read_records(ranges: DataFrame, tasks: int, batch_bytes: int = 1 << 23) -> DataFrame:
    """Every record of the ranges: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The rows of ranges are small and their records large, so they are dealt to ``tasks`` tasks rather than by the rows' size. Records
    are handed on whenever their payloads make ``batch_bytes``, however well they were packed.
    """
    ship(ranges.sparkSession)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with storage.RangeFile(uri) as file:
                    raw, at, found, held = file.read(offset, sum(lengths)), 0, [], 0
                for n in lengths:
                    found.append(parse_record(gzip.decompress(raw[at : at + n])))
                    at, held = at + n, held + len(found[-1]["payload"] or b"")
                    if held >= batch_bytes:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    return ranges.repartition(tasks, "archive", "offset").mapInArrow(tidy(run), schema)


def archive_and_read(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write every page as a record, then read all archives back."""
    archives = staged(write_archives(decided(pages, least)), "archives")
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return read_records(record_ranges(archives), storage.tasks_for(pages.sparkSession, size))
