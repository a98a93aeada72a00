"""WARC archives as a Spark data source, with revisit records.

Writing: one record per page, one gzip member per record, one file per
partition.  A ``response`` holds HTTP headers and the payload; a ``revisit``
holds the HTTP headers alone and names the record with the equal payload.
Each member says its own compressed and uncompressed length in the gzip extra
field (subfield ``SL``), so a reader can step over it.

Reading: partitions are the files of the manifest (or of a folder of
``.warc`` / ``.warc.gz`` files).  A record's headers are decoded first; pushed
predicates on the record type and on headers are tested on them, and only the
payload of a record that passes, and only if payloads are asked for, is
decoded, checked against its digest and returned.  Others are stepped over.
Files of other writers (no lengths in the gzip header, or not compressed, or
with digests of other algorithms, whose names stay in ``payload_digest``) are
read too.

Options: ``path``; ``payload`` (default true).  Predicates are pushed when
``spark.sql.python.filterPushdown.enabled`` is set; ``read`` sets it.

Edge cases: a null payload is empty; a null URL leaves its header out; line
breaks and other control characters in a URL are percent-encoded; a null page
id is written and read as null and is never referred to; rows that repeat the
smallest id of equal payloads are responses each; an empty table gives no
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

from .files import MANIFEST, new_name, open_folder, read_manifest, remove, write_manifest

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")
HEAD_BYTES = 2048
BATCH_BYTES = 8 << 20
_GZIP = struct.Struct("<2sBBIBB")
_SKIP = struct.Struct("<2sHII")  # "SL", 8, compressed length of the member, uncompressed
_ID = re.compile(r"<urn:page:(-?\d+|null)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member that states its lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = _GZIP.size + 2 + _SKIP.size + len(body) + len(tail)
    head = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255) + struct.pack("<H", _SKIP.size)
    return b"".join((head, _SKIP.pack(b"SL", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF), body, tail))


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, sha1: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, payload (binary), sha1 (binary), refers_to."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches) -> Written:
        number = TaskContext.get().partitionId()
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        file, records = new_name(number, ".warc.gz"), 0
        with system.open_output_stream(f"{folder}/{file}", compression=None, buffer_size=1 << 20) as out:
            for batch in batches:
                for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                    out.write(member(record(*(x.as_py() for x in row))))
                    records += 1
        return Written(number, file, records)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        write_manifest(self.path, [vars(m) for m in parts])

    def abort(self, messages) -> None:
        remove(self.path, [m.file for m in messages if m is not None])


@dataclass
class Archive(InputPartition):
    file: str

    def __post_init__(self):
        super().__init__(self.file)


class _Plain:
    """One stored record, decoded as far as it is asked for."""

    def __init__(self, source):
        self.source, self.start, self.seen = source, source.tell(), b""
        self.done = 0

    def some(self, n: int) -> bytes:
        while len(self.seen) < n:
            more = self.source.read(n - len(self.seen))
            if not more:
                break
            self.seen += more
        return self.seen

    def close(self, size: int) -> None:
        self.source.seek(self.start + size)


class _Member:
    """One gzip member, decoded as far as it is asked for."""

    def __init__(self, source):
        self.source, self.start, self.seen = source, source.tell(), b""
        head = source.read(_GZIP.size)
        magic, method, flags, *_ = _GZIP.unpack(head)
        if magic != b"\x1f\x8b" or method != 8:
            raise ValueError(f"no gzip member at byte {self.start}")
        self.size = None
        if flags & 4:
            extra = source.read(struct.unpack("<H", source.read(2))[0])
            if len(extra) >= _SKIP.size and extra[:2] == b"SL":
                _, _, self.size, whole = _SKIP.unpack_from(extra)
                if whole >= 0xFFFFFFF0:
                    self.size = None  # too long for the field
        for bit in (8, 16):  # name, comment
            if flags & bit:
                while source.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            source.read(2)
        self.z = zlib.decompressobj(-15)

    def some(self, n: int) -> bytes:
        parts, have = [self.seen], len(self.seen)
        while have < n and not self.z.eof:
            raw = self.z.unconsumed_tail or self.source.read(max(512, min(1 << 16, n - have)))
            if not raw:
                break
            got = self.z.decompress(raw, n - have)
            parts.append(got)
            have += len(got)
        self.seen = b"".join(parts)
        return self.seen

    def close(self, size: int) -> None:
        if self.size is not None:
            self.source.seek(self.start + self.size)
            return
        while not self.z.eof:  # the length is not stated: decode to the end
            raw = self.z.unconsumed_tail or self.source.read(1 << 16)
            if not raw:
                return
            self.z.decompress(raw, 1 << 20)
        self.source.seek(self.source.tell() - len(self.z.unused_data) + 8)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def agrees(stated: str | None, payload: bytes) -> bool:
    """Whether a stated digest is the payload's: ``algorithm:value``, the value
    in base 32 or hexadecimal.  Algorithms not known here can't be tested."""
    name, _, value = (stated or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if not value or name not in hashlib.algorithms_available or name.startswith("shake"):
        return True
    found = hashlib.new(name, payload)
    value = value.strip()
    return value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=") or value.lower() == found.hexdigest()


def _page(value: str | None):
    m = _ID.search(value or "")
    return None if m is None or m[1] == "null" else int(m[1])


#: Columns that the headers alone decide.
FROM_HEADERS = {
    "record_type": lambda h: h.get("warc-type"),
    "page_id": lambda h: _page(h.get("warc-record-id")),
    "target_uri": lambda h: h.get("warc-target-uri"),
    "refers_to": lambda h: _page(h.get("warc-refers-to")),
    "payload_digest": lambda h: (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if column in FROM_HEADERS:
                self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        system, folder = open_folder(self.path)
        if system.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            names = [p["file"] for p in read_manifest(self.path)]
        else:
            names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(folder))
                           if i.base_name.endswith((".warc", ".warc.gz")))
        return [Archive(n) for n in names] or [Archive("")]

    def _records(self, source, size: int, packed: bool):
        """(headers, the block's bytes or None) of the records that pass."""
        while source.tell() < size:
            item = _Member(source) if packed else _Plain(source)
            n = HEAD_BYTES
            while (end := item.some(n).find(b"\r\n\r\n")) < 0:
                if len(item.seen) < n:
                    raise ValueError("a record's headers do not end")
                n *= 2
            head = _headers(item.seen[:end])
            length = int(head.get("content-length", 0))
            passes = all(FROM_HEADERS[c](head) in values for c, values in self.wanted)
            if passes:
                upto = end + 4 + length
                if self.payload:
                    http = item.some(upto)
                else:  # as far as the HTTP headers go
                    n = min(upto, end + 4 + HEAD_BYTES)
                    while (http := item.some(n)).find(b"\r\n\r\n", end + 4, upto) < 0 and n < upto:
                        n = min(upto, 2 * n)
                yield head, http[end + 4:upto]
            item.close(end + 4 + length + 4)

    def read(self, part: Archive):
        if not part.file:
            return
        names = ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows: list[list] = [[] for _ in names]
        held = 0

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
            for c in rows:
                c.clear()
            return out

        system, folder = open_folder(self.path)
        with system.open_input_file(f"{folder}/{part.file}") as source:
            for head, block in self._records(source, source.size(), part.file.endswith(".gz")):
                values = {c: f(head) for c, f in FROM_HEADERS.items()}
                end = block.find(b"\r\n\r\n")
                http = _headers(block[:end]) if end >= 0 else {}
                values["payload_bytes"] = int(http["content-length"]) if "content-length" in http else None
                values["payload"] = None
                if self.payload and values["record_type"] == "response":
                    values["payload"] = block[end + 4:]
                    if not agrees(head.get("warc-payload-digest"), values["payload"]):
                        raise ValueError(f"{part.file}: the digest of {head.get('warc-record-id')} differs")
                for c, column in zip(names, rows):
                    column.append(values[c])
                held += len(values["payload"] or b"") + 200
                if held >= BATCH_BYTES:
                    yield batch()
                    held = 0
        if rows[0]:
            yield batch()


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          least_bytes: int = 0) -> None:
    """Write one record per row; of records with equal payloads of at least
    ``least_bytes`` the one with the smallest id is the response."""
    pages.sparkSession.dataSource.register(Warc)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(
        F.col("sha1").alias("_sha1"), "first")
    same = (F.col("sha1") == F.col("_sha1")) & (F.octet_length("payload") >= least_bytes)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows.join(firsts, same, "left").select("page_id", "url", "payload", "sha1", refers.alias("refers_to")) \
        .write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
