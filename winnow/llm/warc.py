"""Web archives as a Python data source: records are written and read by Spark tasks.

Writing: every task fills files of its own, one gzip member per record, and names them in its
commit message; the commit writes a manifest, so files of lost attempts are never read.
Reading: files are dealt out into partitions by size. Of a record the head is inflated and
parsed first; a record that the pushed predicates rule out is skipped by the member's length,
which the gzip header holds, and so is a payload that nobody asked for.

Predicates on ``record_type``, ``record_id`` and ``target_uri`` are pushed down, by options
(:func:`read_warc`), or by Spark where ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from winnow.llm.common import scratch

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, content_length long, headers map<string,string>, payload binary")
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()),
    ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
#: Fixed values of the format.
VERSION = b"WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads under this size are never revisits.
LEAST_REVISIT = 100
MANIFEST = "_committed.json"
ROLL = 64 << 20
PLAN = 64 << 20
BATCH = 8 << 20
_PUSHED = ("record_type", "record_id", "target_uri")


def _header_value(value: object) -> str:
    """A header value on one line: control characters become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value)).strip()


def encode_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member whose extra field holds the member's length."""
    lines = [VERSION, *(f"{k}: {_header_value(v)}".encode() for k, v in headers if v is not None),
             b"Content-Length: %d" % len(block)]
    plain = b"\r\n".join([*lines, b"", b""]) + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class _Source:
    """Bytes of a file, buffered; ``skip`` seeks where the file can."""

    def __init__(self, file) -> None:
        self.file, self.buffer = file, b""

    def need(self, size: int) -> bytes:
        while len(self.buffer) < size:
            more = self.file.read(max(1 << 16, size - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer

    def skip(self, size: int) -> None:
        if size <= len(self.buffer):
            self.buffer = self.buffer[size:]
        else:
            self.file.seek(self.file.tell() + size - len(self.buffer))
            self.buffer = b""


def _members(file) -> Iterator[tuple[dict[str, str], object]]:
    """(headers, function that gives the block) of each record; what isn't asked for is skipped."""
    source = _Source(file)
    while len(source.need(24)) > 0:
        start = source.buffer[:24]
        if start[:2] == b"\x1f\x8b":
            size = struct.unpack("<I", start[16:20])[0] if start[3] == 4 and start[12:14] == b"sl" else None
            unzip = zlib.decompressobj(31)
            if size is None:  # a member of another writer: inflate it to find its end
                plain = b""
                while not unzip.eof:
                    plain += unzip.decompress(source.buffer)
                    source.buffer = unzip.unused_data if unzip.eof else b""
                    if not unzip.eof and not source.need(1):
                        raise EOFError("a record is cut off")
                yield from _plain(_Source(pa.BufferReader(plain)))
                continue
            plain, at = b"", 0
            while b"\r\n\r\n" not in plain and at < size:
                step = min(size, max(1024, 2 * at))
                plain += unzip.decompress(source.need(step)[at:step])
                at = step
            head, _, rest = plain.partition(b"\r\n\r\n")
            headers = _parse_head(head)

            def block(rest=rest, at=at, size=size, unzip=unzip, headers=headers) -> bytes:
                return (rest + unzip.decompress(source.need(size)[at:size]))[: int(headers.get("content-length", 0))]

            yield headers, block
            source.skip(size)
        else:
            yield from _plain(source, once=True)


def _plain(source: _Source, once: bool = False) -> Iterator[tuple[dict[str, str], object]]:
    """Records that aren't compressed."""
    while source.need(1):
        size = 1 << 12
        while b"\r\n\r\n" not in source.need(size)[:size] and len(source.buffer) >= size:
            size *= 2
        head = source.buffer[:source.buffer.find(b"\r\n\r\n")]
        headers = _parse_head(head.lstrip(b"\r\n"))
        length = int(headers.get("content-length", 0))

        def block(start=len(head) + 4, length=length) -> bytes:
            return source.need(start + length)[start:start + length]

        yield headers, block
        source.skip(len(head) + 4 + length + 4)
        if once:
            return


def _row(headers: dict[str, str], block, with_payload: bool) -> dict:
    def urn(name: str) -> str | None:
        value = headers.get(name)
        return value.strip("<>") if value is not None else None

    payload = None
    if with_payload:
        payload = block()
        if headers.get("content-type", "").startswith("application/http"):
            payload = payload.partition(b"\r\n\r\n")[2]
    length = headers.get("x-payload-length")
    return {
        "record_id": urn("warc-record-id"), "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"), "refers_to": urn("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest"),
        "payload_length": int(length) if length is not None else None,
        "content_length": int(headers.get("content-length", 0)), "headers": list(headers.items()), "payload": payload,
    }


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcReader(DataSourceReader):
    """Reads with the predicates that the options hold."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests = [tuple(t) for t in json.loads(options.get("predicates", "[]"))]
        self.plan = int(options.get("planbytes", PLAN))

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        listed = {i.base_name: i for i in store.get_file_info(fs.FileSelector(root)) if i.is_file}
        if MANIFEST in listed:
            with store.open_input_stream(listed[MANIFEST].path) as file:
                names = json.loads(file.read())
        else:
            names = sorted(n for n in listed if n.endswith((".warc", ".warc.gz")))
        dealt, size = [[]], 0
        for info in (listed[n] for n in names):
            if dealt[-1] and size + info.size > self.plan:
                dealt.append([])
                size = 0
            dealt[-1].append(info.path)
            size += info.size
        return [_Files(files) for files in dealt]

    def wanted(self, headers: dict[str, str]) -> bool:
        found = {"record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"),
                 "record_id": headers.get("warc-record-id", "").strip("<>") or None}
        for name, kind, value in self.tests:
            have = found[name] if name in found else headers.get(name.lower())
            if have is None or not (have.startswith(value) if kind == "prefix" else have in value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.files:
            with store.open_input_file(path) as file:
                for headers, block in _members(file):
                    if self.wanted(headers):
                        rows.append(_row(headers, block, self.payload))
                        size += 1000 + len(rows[-1]["payload"] or b"")
                        if size > BATCH:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class PushingWarcReader(WarcReader):
    """Also takes the predicates that Spark pushes."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in _PUSHED:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            elif not isinstance(f, IsNotNull):
                yield f
            else:
                self.tests.append((name, "prefix", ""))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceWriter):
    """Writes ``record_id``, ``record_type``, ``target_uri``, ``refers_to``, ``payload``, ``payload_digest``."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, file, size = [], None, 0
        try:
            for row in rows:
                if file is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    file, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                full = bytes(row.payload or b"")
                revisit = row.record_type == "revisit"
                record = encode_record([
                    ("WARC-Type", row.record_type), ("WARC-Record-ID", f"<{row.record_id}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row.target_uri),
                    ("WARC-Refers-To", f"<{row.refers_to}>" if row.refers_to else None),
                    ("WARC-Profile", PROFILE if revisit else None),
                    ("WARC-Payload-Digest", row.payload_digest), ("X-Payload-Length", len(full)),
                    ("Content-Type", "application/http;msgtype=response"),
                ], HTTP if revisit else HTTP + full)
                file.write(record)
                size += len(record)
                if size > ROLL:
                    file.close()
                    file = None
        finally:
            if file is not None:
                file.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as file:
            file.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list) -> None:
        """Nothing to undo: without a manifest entry a file isn't read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("sparkpushes", "false") == "true"
        return (PushingWarcReader if pushing else WarcReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, *, types: list[str] | None = None, payload: bool = True,
              headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Records of a folder of archives; no record, no row.

    ``types`` and ``headers`` (a name and the values it may have) are tested on the parsed
    head, before a payload is inflated; without ``payload`` that column is null. A record
    whose header is absent doesn't pass a test of it.
    """
    _register(spark)
    tests = [("record_type", "in", types)] if types is not None else []
    tests += [(name, "in", list(values)) for name, values in (headers or {}).items()]
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return (spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
            .option("predicates", json.dumps(tests)).option("sparkPushes", pushes).load())


def as_records(pages: DataFrame) -> DataFrame:
    """Records of pages: of equal payloads, all but that of the smallest page are revisits.

    Payloads under :data:`LEAST_REVISIT` bytes are responses. Null html is an empty payload.
    Rows that share the smallest ``page_id`` are all responses; a null ``page_id`` is a
    revisit if an equal payload has an id, else a response. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    first = (rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    rows = rows.join(first, "digest", "left")
    other = long & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))

    def urn(column: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")))

    return rows.select(
        urn("page_id").alias("record_id"), F.when(other, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(other, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload")


def write_warc(records: DataFrame, path: str | None = None) -> str:
    """Write records (columns as :func:`as_records`) to a new folder, which is returned."""
    _register(records.sparkSession)
    path = path or scratch(records.sparkSession, "warc")
    records.write.format("warc").option("path", path).mode("append").save()
    return path


def page_id(urn: str):
    """The id in a ``urn:page:`` name; null for a page without id."""
    return F.expr(f"try_cast(substring({urn}, 10) as bigint)")
