"""WARC archives as a Python data source.

Reading plans whole files, several small ones or one large one to a partition.
Record headers are parsed first; filters on record_type and on header columns
are pushed down and tested on them, and the payload of a record that is not
wanted (or not asked for) is skipped, not decoded. Files are gzip members, one
per record, each with its length in the member's extra field, so a skipped
payload is not even inflated; files without that field are inflated and
skipped.

Writing gives every task files of its own, named by task attempt; the commit
lists the committed ones in a manifest, and readers of a written folder trust
that list, so files of lost or repeated attempts are never read.

Deduplication by payload: of records with equal payloads of at least
``min_bytes`` the one with the largest id is the response; the others are
revisits that refer to it and carry no payload. Rows that repeat that id are
responses too. Smaller payloads are all responses. Null payloads are empty.
Rows without an id are responses of their own, or revisits of one with an id.
"""
from __future__ import annotations

import base64
import fnmatch
import hashlib
import io
import json
import struct
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from massloom.llm.storage import stored

SCHEMA = ("record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary")
#: WARC header fields behind the columns that filters may name.
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
ID_PREFIX = "<urn:page:"
EMPTY_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_committed.json"
MEMBER = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' holds its own length and that of the data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<H", 8)
    total = len(MEMBER) + 2 + len(extra) + 8 + len(body) + 8
    return (MEMBER + struct.pack("<H", len(extra) + 8) + extra + struct.pack("<II", total, len(data)) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def record(page_id, url, payload: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the length of the full payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"{ID_PREFIX}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", EMPTY_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"{ID_PREFIX}{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceWriter):
    """Rows (page_id, url, payload, payload_bytes, payload_digest, refers_to)."""

    def __init__(self, options):
        self.path = options["path"]
        self.roll = int(options.get("rollBytes", 64 << 20))

    def write(self, iterator):
        from pyspark import TaskContext

        files, out, size = [], None, 0
        where, base = _filesystem(self.path)
        where.create_dir(base, recursive=True)
        for r in iterator:
            if out is None:
                name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                out, size = where.open_output_stream(f"{base}/{name}", compression=None), 0
                files.append(name)
            data = _member(record(r.page_id, r.url, bytes(r.payload or b""), r.payload_bytes, r.payload_digest, r.refers_to))
            out.write(data)
            size += len(data)
            if size >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()
        return _Files(files)

    def commit(self, messages) -> None:
        where, base = _filesystem(self.path)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        """Files of a failed write stay unlisted."""


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class _Part(InputPartition):
    def __init__(self, files):
        super().__init__(files)
        self.files = files


def members(stream, size: int):
    """(position, length, length of the data) of gzip members with their length, up to the first without: (position, None, None)."""
    at = 0
    while at < size:
        stream.seek(at)
        head = stream.read(24)
        total, length = struct.unpack("<II", head[16:24]) if head[:4] == MEMBER[:4] and head[12:14] == b"sl" and len(head) == 24 else (0, 0)
        if total <= 24:
            yield at, None, None
            return
        yield at, total, length
        at += total


def headers(read) -> tuple[str, dict] | None:
    """Version line and header fields from a reader of lines."""
    line = read()
    while line in (b"\r\n", b"\n"):
        line = read()
    if not line:
        return None
    fields, last = {}, None
    version = line.strip().decode("latin-1")
    while True:
        line = read()
        if line in (b"\r\n", b"\n", b""):
            return version, fields
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()


class _Span:
    """``size`` bytes of a file from ``at`` on, read in small blocks as they are asked for."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.end = f, at, at + size

    def read(self, n: int) -> bytes:
        self.f.seek(self.at)
        data = self.f.read(min(n, 4096, self.end - self.at))
        self.at += len(data)
        return data


class _Inflate(io.RawIOBase):
    """Inflates a gzip file of one or many members as it is read."""

    def __init__(self, raw):
        self.raw, self.z, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, target):
        while True:
            data = self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return 0
            out = self.z.decompress(data, len(target))
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                target[: len(out)] = out
                return len(out)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.columns = options["path"], [f.name for f in schema]
        self.types = {f.name: f for f in schema}
        self.split = int(options.get("splitBytes", 32 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.wants: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADER_OF:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wants.append((column, {f.value}))
            elif isinstance(f, In):
                self.wants.append((column, set(f.value)))
            elif isinstance(f, IsNotNull):
                self.wants.append((column, None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, base = _filesystem(self.path)
        if where.get_file_info(base).type == fs.FileType.File:
            infos = [where.get_file_info(base)]
        elif where.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with where.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
                names = json.loads(f.read())
            infos = where.get_file_info([f"{base}/{n}" for n in names])
        else:
            infos = [i for i in where.get_file_info(fs.FileSelector(base, recursive=True))
                     if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, "*.warc*")]
        parts, group, held = [], [], 0
        for i in sorted(infos, key=lambda i: i.path):
            group.append((i.path, i.size))
            held += i.size
            if held >= self.split:
                parts.append(_Part(group))
                group, held = [], 0
        if group or not parts:
            parts.append(_Part(group))
        return parts

    def _wanted(self, fields: dict) -> bool:
        row = self._head(fields)
        return all(row[c] is not None if values is None else row[c] in values for c, values in self.wants)

    @staticmethod
    def _number(name: str | None):
        body = name[len(ID_PREFIX):-1] if name and name.startswith(ID_PREFIX) else ""
        return int(body) if body.lstrip("-").isdigit() else None

    def _head(self, fields: dict) -> dict:
        digest = fields.get("warc-payload-digest")
        return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
                "page_id": self._number(fields.get("warc-record-id")), "refers_to": self._number(fields.get("warc-refers-to")),
                "payload_digest": digest.removeprefix("sha1:") if digest else None, "payload_bytes": None, "payload": None}

    def read(self, partition):
        where, _ = _filesystem(self.path)
        for path, size in partition.files:
            with where.open_input_file(path) as f:
                for at, total, _ in members(f, size):
                    if total is None:
                        yield from self._rest(f, at, path)
                    else:
                        lines = io.BufferedReader(_Inflate(_Span(f, at, total)), 1024)
                        yield from self._one(lines, lambda at=at, total=total: self._whole(f, at, total))

    def _rest(self, f, at: int, path: str):
        """All records from a position on, whatever their members look like."""
        f.seek(at)
        magic = f.read(24)
        if at and magic[:2] != b"\x1f\x8b" and not magic.lstrip(b"\r\n").startswith(b"WARC/"):
            if magic.strip(b"\0"):
                raise ValueError(f"{path} holds no record at {at}")
            return  # padding
        f.seek(at)
        lines = io.BufferedReader(_Inflate(f) if magic[:2] == b"\x1f\x8b" else _Raw(f), 1 << 16)
        while True:
            found = headers(lines.readline)
            if found is None:
                break
            yield from self._record(found[1], lines, None)

    def _whole(self, f, at: int, total: int):
        f.seek(at)
        return io.BufferedReader(io.BytesIO(zlib.decompress(f.read(total), 31)))

    def _one(self, lines, reopen):
        """A record alone in its member, inflated as far as its headers go."""
        found = headers(lines.readline)
        if found is not None and self._wanted(found[1]):
            whole = reopen()
            yield from self._record(headers(whole.readline)[1], whole, True)

    def _record(self, fields: dict, lines, alone):
        length = int(fields.get("content-length", 0))
        if not self._wanted(fields):
            _skip(lines, length)
            return
        row, left = self._head(fields), length
        full = None
        if fields.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = lines.readline(left)
                left -= len(line)
                name, _, value = line.decode("latin-1").partition(":")
                if name.strip().lower() == "content-length" and value.strip().isdigit():
                    full = int(value)
                if line in (b"\r\n", b"\n", b""):
                    break
        revisit = row["record_type"] == "revisit"
        row["payload_bytes"] = full if revisit and full is not None else left
        check = self.verify and not revisit and row["payload_digest"]
        if ("payload" in self.columns and not revisit) or check:
            payload = lines.read(left)
            if check and base32_sha1(payload) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
            row["payload"] = payload
        else:
            _skip(lines, left)
        yield tuple(row[c] for c in self.columns)


class _Raw(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def readinto(self, target):
        data = self.f.read(len(target))
        target[: len(data)] = data
        return len(data)


def _skip(lines, n: int) -> None:
    while n > 0:
        got = len(lines.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_of_hex(h: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(4):
        word = F.conv(F.substring(h, k * 10 + 1, 10), 16, 10).cast("long")
        parts += [F.substring(alphabet, (F.shiftright(word, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def archive_plan(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows for the writer: which record keeps its payload and which refers to it."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("owner"))
    rows = rows.join(stored(kept, "payload-owners"), "sha", "left")  # both sides are shuffled for it, so hot payloads are split
    refers = F.when((F.col("payload_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return rows.withColumn("refers_to", refers).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes",
        base32_of_hex(F.col("sha")).alias("payload_digest"), "refers_to")
