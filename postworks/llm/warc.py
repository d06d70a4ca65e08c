"""Operator 7: WARC archives as a Spark data source (format "warc"), written and read.

Reading. The driver plans partitions from the archive's manifest: stretches of
files between places at which records begin, which the writer has noted, and
small files together. Predicates on the record type and on other headers are
pushed down. A task parses a record's headers first; if they don't fit, or if
no payload is asked for, it skips the rest without decoding it: the length of
each compressed record stands in its gzip header (the "sl" field that the WARC
standard describes), so skipping is a seek. Files without that field are read
through.

Writing. Each task writes compressed files, a new one when one is full. The
commit puts the names of the files of successful attempts into a manifest in
one step; files of lost attempts are never listed, hence never read.

Deduplication. Of records with equal payloads of at least `min_bytes`, the one
with the smallest id is a response; the others are revisits that name it and
carry no payload, but its digest and, as HTTP Content-Length, its length. Which
is which is decided on ids and digests alone.

Defined results: a null payload is an empty one; a row with a null id is a
response of its own; rows that repeat the smallest id are all responses; a null
URL writes no target header. Control characters in a URL are percent-encoded.
Other columns are not read. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from postworks.llm.scratch import shared_path, written

MANIFEST = "_manifest.json"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_READ_BYTES = 1 << 16


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member, whose header tells its compressed and plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    extra = b"sl" + struct.pack("<HII", 8, (len(head) + 2 + 12 + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, date: str, refers_to: str | None, payload: bytes, payload_digest: str, length: int) -> bytes:
    """The bytes of a record; a revisit has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    clean = None if uri is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *([f"WARC-Target-URI: {clean}"] if clean else [])]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Files(WriterCommitMessage):
    files: list


@dataclass
class _Part(InputPartition):
    stretches: list  # (file, first byte, last byte or None)


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, warc_date, refers_to, payload_digest, payload_bytes, payload) to files."""

    def __init__(self, path: str, file_bytes: int, split_bytes: int):
        self.path, self.file_bytes, self.split_bytes = path, file_bytes, split_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _place(self.path)
        store.create_dir(path, recursive=True)
        attempt, files, out, size, name, splits = uuid.uuid4().hex, [], None, 0, "", []
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes", "payload")]
            for i in range(batch.num_rows):
                kind, rid, uri, date, ref, dig, n, payload = (c[i].as_py() for c in columns)
                if out is None:
                    name, size, splits = f"part-{attempt}-{len(files):05d}.warc.gz", 0, []
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = member(record(kind, rid, uri, date, ref, payload or b"", dig, n))
                if size >= (len(splits) + 1) * self.split_bytes:
                    splits.append(size)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append([name, size, splits])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size, splits])
        return _Files(files)

    def commit(self, messages: list) -> None:
        store, path = _place(self.path)
        store.create_dir(path, recursive=True)
        files = [x for m in messages if m for x in m.files]
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:  # an archive that is added to
            with store.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
                files += json.loads(f.read())
        draft = f"{path}/_draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(sorted(files)).encode())
        store.move(draft, f"{path}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        store, path = _place(self.path)
        for name, *_ in (x for m in messages if m for x in m.files):
            store.delete_file(f"{path}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.part_bytes = int(options.get("partition_bytes", 32 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _FIELDS and isinstance(f, EqualTo):
                self.tests.append(("in", column, (f.value,)))
            elif column in _FIELDS and isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif column in _FIELDS and isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            elif column in _FIELDS and isinstance(f, IsNotNull):
                self.tests.append(("known", column, None))
            else:
                yield f

    def partitions(self) -> list:
        store, path = _place(self.path)
        info = store.get_file_info(f"{path}/{MANIFEST}")
        if info.type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
                files = json.loads(f.read())
        else:
            files = sorted([x.base_name, x.size, []] for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        parts, held = [_Part([])], 0
        for name, size, *splits in files:
            # A stretch ends at the last place that fits in, or else at the next one.
            edges, begin = [*(splits[0] if splits else []), size], 0
            for at, edge in enumerate(edges):
                if at + 1 < len(edges) and held + edges[at + 1] - begin <= self.part_bytes:
                    continue
                if parts[-1].stretches and held + edge - begin > self.part_bytes:
                    parts.append(_Part([]))
                    held = 0
                parts[-1].stretches.append((name, begin, edge if edge < size else None))
                held += edge - begin
                begin = edge
        return parts

    def _fits(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if x is None or (kind == "in" and x not in value) or (kind == "starts" and not x.startswith(value)):
                return False
        return True

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, path = _place(self.path)
        rows, size = [], 0
        for name, begin, end in partition.stretches:
            with store.open_input_file(f"{path}/{name}") as f:
                for row in self._records(f, name, begin, end):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, f, name: str, offset: int, end: int | None) -> Iterator[dict]:
        end = f.size() if end is None else end
        while offset < end:
            source = _Member(f, offset) if name.endswith(".gz") else _Plain(f, offset)
            head = source.until(b"\r\n\r\n")
            fields = _headers(head)
            length = int(fields["content-length"])
            row = {c: _bare(fields.get(h)) for c, h in _FIELDS.items()} | {"payload": None, "payload_bytes": None, "file": name, "offset": offset}
            row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
            if self._fits(row):
                row["payload_bytes"] = length
                if fields.get("content-type", "").startswith("application/http"):
                    http = source.until(b"\r\n\r\n")
                    row["payload_bytes"] = int(_headers(http).get("content-length", length - len(http)))
                    length -= len(http)
                if row["record_type"] != "revisit" and (self.payload or self.verify):
                    body = source.take(length)
                    if self.verify and (len(body) != row["payload_bytes"] or row["payload_digest"] not in (None, digest(body))):
                        raise ValueError(f"{name}, record at {offset}: the payload doesn't fit its digest or length")
                    row["payload"] = body if self.payload else None
                yield row
            offset = source.next_offset(len(head) + int(fields["content-length"]) + 4)


class _Plain:
    """Bytes of an uncompressed record."""

    def __init__(self, f, offset: int):
        self.f, self.start, self.buffer, self.at = f, offset, b"", offset

    def more(self) -> bytes:
        self.f.seek(self.at)
        data = self.f.read(_READ_BYTES)
        self.at += len(data)
        return data

    def until(self, mark: bytes) -> bytes:
        while (i := self.buffer.find(mark)) < 0:
            if not (data := self.more()):
                raise ValueError("an archive ends within a record's headers")
            self.buffer += data
        out, self.buffer = self.buffer[: i + len(mark)], self.buffer[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts = [self.buffer]
        got = len(self.buffer)
        while got < n:
            if not (data := self.more()):
                raise ValueError("an archive ends within a record")
            parts.append(data)
            got += len(data)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def next_offset(self, plain_length: int) -> int:
        return self.start + plain_length


class _Member(_Plain):
    """Bytes of a record that is one gzip member; no more is inflated than is asked for."""

    def __init__(self, f, offset: int):
        super().__init__(f, offset)
        f.seek(offset)
        head = f.read(24)
        self.skip = struct.unpack("<I", head[16:20])[0] if head[3:4] == b"\x04" and head[12:14] == b"sl" else None
        self.inflate = zlib.decompressobj(31)
        self.rest = b""

    def more(self) -> bytes:
        while not self.inflate.eof:
            if not self.rest and not (packed := super().more()):
                break
            data = self.inflate.decompress(self.rest or packed, _READ_BYTES)
            self.rest = self.inflate.unconsumed_tail
            if data:
                return data
        return b""

    def next_offset(self, plain_length: int) -> int:
        if self.skip:
            return self.start + self.skip
        while self.more():
            pass
        return self.at - len(self.inflate.unused_data)


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


class WarcSource(DataSource):
    """Options: path; partition_bytes; payload (false: never decoded); verify (true: payloads are checked against their digests); file_bytes; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 256 << 20)), int(self.options.get("split_bytes", 8 << 20)))


def to_records(df: DataFrame, id_column: str, url_column: str, payload_column: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row, as WarcWriter takes them; repeated payloads are revisits."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_column).alias("id"), F.col(url_column).alias("target_uri"), payload.alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    narrow = rows.select("id", "key", F.octet_length("payload").alias("n"))
    # One row for each digest that repeats, from counts made before the shuffle; then the rows that revisit it.
    first = narrow.where(F.col("n") >= min_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1").select("key", "first")
    roles = written(narrow.select("id", "key").distinct().join(written(first, "warc-first"), "key").where("first < id"), "warc-roles")
    # By id and digest: copies of one payload are many ids.
    joined = rows.join(roles, ["id", "key"], "left").withColumn("refers_to", F.concat(F.lit("urn:row:"), F.col("first").cast("string")))
    return joined.select(
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit("urn:row:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(F.col("target_uri") != "", F.col("target_uri")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        "refers_to",
        _base32(F.col("key")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )


def _base32(sha1: F.Column) -> F.Column:
    """Base32 text of 20 bytes, 5 hex digits (4 characters) at a time."""
    digits = F.hex(sha1)
    groups = [F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(alphabet, F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def write_archive(records: DataFrame, path: str | None = None, file_bytes: int = 256 << 20, split_bytes: int = 8 << 20) -> str:
    """Write an archive; returns its path."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    path = path or shared_path(spark, "warc")
    records.write.format("warc").mode("append").option("path", path).option("file_bytes", file_bytes).option("split_bytes", split_bytes).save()
    return path


def read_archive(spark, path: str, **options) -> DataFrame:
    """Records of an archive, as SCHEMA says; filters on header columns are pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(path=path, **{k: str(v).lower() for k, v in options.items()}).load()
