"""WARC archives as a Spark data source, ``format("warc")``.

Writing gives one gzip member per record. The member's extra field ``SL`` holds its own length and the length of the
record, so a reader can go from record to record without inflating what it doesn't want. Each task writes files of its
own, of at most ``file_bytes`` inflated bytes; the driver lists the files of the tasks that count in ``_manifest.json``,
so what a lost or repeated task left behind is never read.

Reading plans one partition for about ``partition_bytes`` of whole files. Per record, the headers are inflated and
parsed first and compared with the pushed predicates (record type and any column that comes from a header); the payload
is inflated only for records that pass, and only if the requested schema has ``payload``. A payload that is read is
checked against its digest. Members without ``SL`` and plain ``.warc`` files are read too, the former by inflating.

Paths are anything pyarrow's file systems open by URI; a plain path must be in a folder that all machines share.

Nulls and odd rows: a null payload is an empty one, a null URI or id leaves its header out; line ends in header values
are percent-encoded; repeated rows become repeated records; no rows give archives without records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.tables import LAST_ID, given_id

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
          "payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary")

#: Columns that come from the record's headers alone.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
             "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
_BLOCK = 1 << 20
_HEAD = 4096
_LONG = 0xFFFFFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records

def _clean(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, date: str) -> bytes:
    """One record as bytes. A revisit has the HTTP headers of its payload and no payload."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    size = row.get("payload_bytes")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload) if size is None else size}\r\n\r\n").encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id")), ("WARC-Date", row.get("warc_date") or date),
            ("WARC-Target-URI", row.get("target_uri")),
            ("WARC-Payload-Digest", f"sha1:{row.get('payload_digest') or digest(payload)}")]
    if kind == "revisit":
        head += [("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field has the lengths of the member and of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    whole = 24 + len(body) + 8
    head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 4, 255, 12, b"SL", 8, min(whole, _LONG),
                       min(len(data), _LONG))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Blocks:
    """Positioned reads of a file through blocks, so that going from record to record costs few calls."""

    def __init__(self, file):
        self.file, self.size, self.at, self.have = file, file.size(), 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if not (self.at <= pos and pos + n <= self.at + len(self.have)):
            self.file.seek(pos)
            self.at, self.have = pos, self.file.read(min(max(n, _BLOCK), self.size - pos))
        return self.have[pos - self.at:pos - self.at + n]


class _Member:
    """The inflated bytes of the gzip member at ``pos``, inflated only as far as they are asked for."""

    def __init__(self, blocks: _Blocks, pos: int):
        self.blocks, self.pos = blocks, pos
        head = blocks.get(pos, 24)
        self.length = None
        if len(head) == 24 and head[3] == 4 and head[12:14] == b"SL":
            length = struct.unpack("<I", head[16:20])[0]
            self.length = None if length == _LONG else length
        self.z, self.out, self.fed = zlib.decompressobj(31), b"", pos

    def upto(self, n: int | None) -> bytes:
        parts, have = [self.out], len(self.out)
        while not self.z.eof and (n is None or have < n):
            waiting = self.z.unconsumed_tail
            if not waiting:
                step = _HEAD if n is not None and n <= _HEAD else _BLOCK
                if self.length is not None:
                    step = min(step, self.pos + self.length - self.fed)
                waiting = self.blocks.get(self.fed, step)
                self.fed += len(waiting)
                if not waiting:
                    break
            piece = self.z.decompress(waiting, 0 if n is None else n - have)
            parts.append(piece)
            have += len(piece)
        self.out = b"".join(parts)
        return self.out

    def end(self) -> int:
        if self.length is not None:
            return self.pos + self.length
        while not self.z.eof and (waiting := self.z.unconsumed_tail or self._more()):
            self.z.decompress(waiting, _BLOCK)
        return self.fed - len(self.z.unused_data)

    def _more(self) -> bytes:
        waiting = self.blocks.get(self.fed, _BLOCK)
        self.fed += len(waiting)
        return waiting


class _Plain:
    """A record of a file that isn't compressed."""

    def __init__(self, blocks: _Blocks, pos: int):
        self.blocks, self.pos, self.whole = blocks, pos, 0

    def upto(self, n: int | None) -> bytes:
        return self.blocks.get(self.pos, self.whole if n is None else n)

    def end(self) -> int:
        return self.pos + self.whole


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def sha1_of(text: str | None) -> tuple[str | None, bool]:
    """A digest as it is shown, and whether it is one to compare: SHA-1, in base32 or hexadecimal, becomes bare base32."""
    kind, colon, value = (text or "").partition(":")
    value = value if colon else kind
    if colon and kind.lower() not in ("sha1", "sha-1"):
        return text, False
    with contextlib.suppress(ValueError):
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper()) if len(value) == 32 else b""
        if len(raw) == 20:
            return base64.b32encode(raw).decode(), True
    return text, False


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; a body that isn't well-formed is returned as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            return body
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def records(file, compressed: bool, wanted, with_payload: bool, strict: bool = True) -> Iterator[dict]:
    """Rows of one archive. ``wanted(row)`` sees the header columns before a payload is inflated.

    Only records of ``application/http`` are taken apart into headers and payload; of others the whole block is the payload. A payload that
    doesn't have its digest is an error, or, if not ``strict``, a row whose ``digest_ok`` is false; it is null where no digest is understood.
    """
    blocks, pos = _Blocks(file), 0
    while pos < blocks.size:
        item = (_Member if compressed else _Plain)(blocks, pos)
        n = _HEAD
        while (cut := (got := item.upto(n)).find(b"\r\n\r\n")) < 0:
            if len(got) < n:
                raise ValueError(f"no end of the record's headers at byte {pos}")
            n *= 4
        head = _headers(got[:cut])
        length = int(head.get("content-length", 0))
        if not compressed:
            item.whole = cut + 4 + length + 4
        row = {c: head.get(h) for c, h in HEADER_OF.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else row[c]
        row["payload_digest"], known = sha1_of(row["payload_digest"])
        if wanted(row):
            block_at = cut + 4
            body = item.upto(None if with_payload else min(block_at + length, n))[block_at:block_at + length]
            http, payload = {}, body
            if head.get("content-type", "").lower().startswith("application/http") and (http_end := body.find(b"\r\n\r\n")) >= 0:
                http, payload = _headers(body[:http_end]), body[http_end + 4:]
            row["payload_bytes"], row["headers"] = _number(http.get("content-length")), list(head.items())
            if with_payload:
                plain = dechunked(payload) if http.get("transfer-encoding", "").lower() == "chunked" else payload
                if row["record_type"] != "revisit":
                    row["payload_bytes"] = len(plain)
                    if known:
                        row["digest_ok"] = row["payload_digest"] in (digest(plain), digest(payload))
                        if not row["digest_ok"] and strict:
                            raise ValueError(f"payload of {row['record_id']} doesn't have its digest")
                payload = plain
                row["payload"] = payload
            yield row
        pos = item.end()


# ---------------------------------------------------------------- data source

_COMPARE = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def _predicate(f) -> tuple | None:
    """(kind, column, value) of a filter that headers alone can settle, or None."""
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in HEADER_OF:
        return None
    if type(f) in (IsNotNull, IsNull):
        return type(f), f.attribute[0], None
    return (type(f), f.attribute[0], f.value) if type(f) in _COMPARE else None


def _passes(row: dict, pushed: list[tuple]) -> bool:
    for kind, column, value in pushed:
        have = row[column]
        if kind is IsNull:
            if have is not None:
                return False
        elif have is None or (kind is not IsNotNull and not _COMPARE[kind](have, value)):
            return False
    return True


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.strict = options.get("digests", "fail") != "flag"
        self.names = [f.name for f in schema.fields]
        self.arrow = to_arrow_schema(schema)
        self.uri, self.limit, self.pushed = options["path"], int(options.get("partition_bytes", 64 << 20)), []

    def pushFilters(self, filters):
        for f in filters:
            p = _predicate(f)
            if p is None:
                yield f
            else:
                self.pushed.append(p)

    def partitions(self):
        files, path = opened(self.uri)
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [info]
        elif files.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with files.open_input_stream(f"{path}/{MANIFEST}") as f:
                found = files.get_file_info([f"{path}/{x}" for x in json.loads(f.read())])
        else:
            found = [x for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith((".warc", ".warc.gz"))]
        groups, room = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not groups or room + x.size > self.limit:
                groups.append([])
                room = 0
            groups[-1].append(x.path)
            room += x.size
        return [Archives(tuple(g)) for g in groups]

    def read(self, partition):
        if partition is None:
            return
        files, _ = opened(self.uri)
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as f:
                for row in records(f, path.endswith(".gz"), lambda r: _passes(r, self.pushed), "payload" in self.names, self.strict):
                    rows.append({c: row.get(c) for c in self.names})
                    size += 200 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.uri, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes, self.level = int(options.get("file_bytes", 1 << 30)), int(options.get("level", 1))
        self.overwrite = overwrite

    def write(self, iterator) -> Written:
        files, path = opened(self.uri)
        files.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                data = record({n: c[i].as_py() for n, c in columns.items()}, self.date)
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                out.write(member(data, self.level))
                size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages) -> None:
        files, path = opened(self.uri)
        files.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        at = f"{path}/{MANIFEST}"
        if not self.overwrite and files.get_file_info(at).type == fs.FileType.File:
            with files.open_input_stream(at) as f:
                names = sorted({*json.loads(f.read()), *names})
        with files.open_output_stream(at) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        """Files without a line in the manifest are never read."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---------------------------------------------------------------- pages

def deduplicated(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url",
                 payload_col: str = "html") -> DataFrame:
    """Records of pages. Of equal payloads of at least ``min_bytes`` the one with the smallest id is a response, and
    the others are revisits of it that carry no payload; a row with that same id and payload is a response too."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
                        F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha").agg(F.min("id").alias("first")).hint("shuffle_hash")
    again = (F.col("id") != F.col("first")) & (F.length("payload") >= min_bytes)

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(given_id(c).cast("string"), F.lit("none")), F.lit(">"))

    return rows.join(first, "sha").select(
        urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("uri").alias("target_uri"), F.when(again, urn("first")).alias("refers_to"),
        base32("sha").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"))


def base32(digest_col: str) -> Column:
    """Upper-case base32 of a 20-byte digest, in built-in functions: five bits at a time of its binary digits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex(F.col(digest_col)), 1 + 10 * k, 10), 16, 32), 8, "0")
                      for k in range(4)])
    return F.translate(F.upper(bits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_id(record_id: str) -> Column:
    """The id in a record's URN; null if it has none."""
    return F.regexp_extract(F.col(record_id), r"^urn:page:(-?\d+)$", 1).try_cast("long")
