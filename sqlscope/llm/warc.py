"""WARC as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing makes one gzip member per record, with its compressed and full length in
the member's extra field ("sl"), so a reader steps over a record without
inflating it. Reading plans a partition per run of members, parses the headers
first, applies pushed-down predicates on the record type and other header columns,
and inflates a payload only if the record passed and the payload is asked for
(option ``payload``: "full", "digest" to return only its length and SHA-1, or
"none"). Archives of others (gzip members without the extra field, or not
compressed) are read too, a file per partition.

register() also switches on ``spark.sql.python.filterPushdown.enabled``, which Spark asks
of a session that reads from Python data sources that take filters.

Defined results: a null payload is empty; a very long payload is one record, held
whole by the task that writes or returns it; a null url becomes urn:page:<id>;
control characters and blanks in urls are percent-encoded; rows with repeated
ids are records of their own; an id in a header that is no number is null;
predicates on ids compare numbers; what follows the last record and is none is
passed over; an empty table gives an empty archive; columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from sqlscope.llm import files
from sqlscope.llm.common import materialize, scratch_path, small

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
_SPAN = 32 << 20  # compressed bytes of one reading partition
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(page_id: int | None, payload_digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}:{kind}')}>"


def clean_uri(uri: str | None, page_id: int | None) -> str:
    if not uri:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field holds its compressed and full length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    total = 10 + 14 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def build_record(kind: str, uri: str, date: str, page_id: int | None, refers_to: int | None, payload: bytes, payload_digest: str) -> bytes:
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uuid(page_id, payload_digest, kind)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uuid(refers_to, payload_digest, 'response')}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    entries: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: page_id, url, payload, record_type, refers_to, payload_digest (base32, may be null)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "6")), overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        out, system, folder, name, at, spans = None, None, None, None, 0, [0]
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for page_id, url, payload, kind, refers_to in zip(*cols, strict=True):
                if out is None:
                    system, folder, name = files.new_file(self.path, ".warc.gz")
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                data = payload.as_py() or b""
                pid = page_id.as_py()
                got = member(build_record(kind.as_py(), clean_uri(url.as_py(), pid), self.date, pid, refers_to.as_py(), data, digest32(data)), self.level)
                out.write(got)
                at += len(got)
                if at - spans[-1] >= _SPAN:
                    spans.append(at)
        if out is None:
            return _Written([])
        out.close()
        return _Written([{"file": name, "size": at, "spans": spans}])

    def commit(self, messages: list) -> None:
        files.write_manifest(self.path, [e for m in messages if m for e in m.entries], self.overwrite)

    def abort(self, messages: list) -> None:
        files.delete(self.path, [e["file"] for m in messages if m for e in m.entries])


@dataclass
class _Span(InputPartition):
    file: str
    start: int
    end: int | None


class _Stream:
    """Buffered reading of a file with stepping over."""

    def __init__(self, f, start: int, end: int | None):
        self.f, self.at, self.end = f, start, f.size() if end is None else end
        self.buffer, self.base = b"", start

    def more(self, n: int) -> bytes:
        """``n`` bytes from here (fewer at the end)."""
        if self.at < self.base or self.at + n > self.base + len(self.buffer):
            self.f.seek(self.at)
            self.buffer, self.base = self.f.read(max(n, 1 << 20)), self.at
        return self.buffer[self.at - self.base : self.at - self.base + n]


    def skip(self, n: int | None) -> None:
        self.at = self.end if n is None else self.at + n


class _Inflated:
    """What the gzip members from here on hold, inflated piece by piece; what is skipped is not kept."""

    def __init__(self, s: _Stream):
        self.s, self.z, self.held = s, zlib.decompressobj(31), b""

    def fill(self) -> bool:
        """Some bytes more, or False at the end."""
        while True:
            if self.z.eof:
                if self.s.more(2) != b"\x1f\x8b":
                    self.s.skip(None)
                    return False
                self.z = zlib.decompressobj(31)
            piece = self.z.unconsumed_tail
            if not piece:
                piece = self.s.more(min(1 << 16, self.s.end - self.s.at))
                self.s.at += len(piece)
                if not piece:
                    return False
            got = self.z.decompress(piece, 1 << 18)
            if self.z.eof:
                self.s.at -= len(self.z.unused_data)
            if got:
                self.held += got
                return True

    def more(self, n: int) -> bytes:
        while len(self.held) < n and self.fill():
            pass
        return self.held[:n]

    def skip(self, n: int | None) -> None:
        while n is None or n > len(self.held):
            n = None if n is None else n - len(self.held)
            self.held = b""
            if not self.fill():
                return
        self.held = self.held[n:]


#: Headers whose columns are numbers; bytes of a record's headers at most.
NUMBERS, MOST_HEADERS = ("warc-page-id", "warc-refers-to-page-id"), 1 << 22


class WarcReader(DataSourceReader):
    HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "record_date": "warc-date", "page_id": "warc-page-id", "refers_to": "warc-refers-to-page-id"}

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.tests: list[tuple[str, frozenset]] = []
        self.inflated = 0

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, EqualTo | In) else ""
            if column in self.HEADERS and isinstance(f, EqualTo):
                self.tests.append((self.HEADERS[column], frozenset([f.value])))
            elif column in self.HEADERS and isinstance(f, In):
                self.tests.append((self.HEADERS[column], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = files.read_manifest(self.path)
        system, folder = files.open_fs(self.path)
        if found is not None:
            out: list[InputPartition] = []
            for e in found:
                out += [_Span(f"{folder}/{e['file']}", a, z) for a, z in zip(e["spans"], [*e["spans"][1:], e["size"]], strict=True) if z > a]
        elif system.get_file_info(folder).is_file:
            out = [_Span(folder, 0, None)]
        else:
            out = [_Span(x.path, 0, None) for x in system.get_file_info(files.fs.FileSelector(folder, recursive=True)) if x.is_file and ".warc" in x.base_name]
        return out or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = files.open_fs(self.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(partition.file) as f:
            for row in self.records(_Stream(f, partition.start, partition.end)):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= 4096 or held >= 8 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def records(self, s: _Stream) -> Iterator[tuple]:
        while s.at < s.end:
            start = s.more(24)
            if not start:
                return
            if start[:2] != b"\x1f\x8b":
                yield from self.listed(s)
            elif start[3] == 4 and start[12:14] == b"sl":
                yield from self.stepped(s, start)
            else:
                yield from self.listed(_Inflated(s))

    def stepped(self, s: _Stream, start: bytes) -> Iterator[tuple]:
        """The record of a member that tells its length: it is inflated as a whole only if its payload is wanted."""
        total, _ = struct.unpack("<II", start[16:24])
        headers, _ = parse_headers(zlib.decompressobj(31).decompress(s.more(min(total, 4096)), 8192))
        if headers is not None and not (self.passes(headers) and self.wants(headers)):
            if self.passes(headers):
                yield self.row(headers, None)
        else:
            self.inflated += 1
            record = zlib.decompress(s.more(total), 31)
            headers, rest = parse_headers(record)
            if headers is not None and self.passes(headers):
                yield self.row(headers, record[rest : rest + block_length(headers)] if self.wants(headers) else None)
        s.at += total

    def listed(self, s: "_Stream | _Inflated") -> Iterator[tuple]:
        """All records of a stream, one after another; blocks that are not wanted are stepped over."""
        while True:
            n = 4096
            head = s.more(n)
            while head[:1] in (b"\r", b"\n"):  # blank lines between records
                s.skip(len(head) - len(head.lstrip(b"\r\n")))
                head = s.more(n)
            headers, rest = parse_headers(head)
            while headers is None and len(head) == n and n < MOST_HEADERS:
                n *= 2
                head = s.more(n)
                headers, rest = parse_headers(head)
            if headers is None or not head.startswith(b"WARC/"):
                s.skip(None)  # nothing of an archive follows
                return
            s.skip(rest)
            length = block_length(headers)
            if not self.passes(headers):
                s.skip(length)
            elif self.wants(headers):
                yield self.row(headers, s.more(length))
                s.skip(length)
            else:
                yield self.row(headers, None)
                s.skip(length)

    def passes(self, headers: dict) -> bool:
        return all((number(headers.get(name)) if name in NUMBERS else headers.get(name)) in allowed for name, allowed in self.tests)

    def wants(self, headers: dict) -> bool:
        return self.payload != "none" and headers.get("warc-type") == "response"

    def row(self, headers: dict, block: bytes | None) -> tuple:
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = headers.get("warc-payload-length")
        payload = None
        if block is not None:
            payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
            length, digest = len(payload), digest32(payload)
        return (
            headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"),
            number(headers.get("warc-page-id")), number(headers.get("warc-refers-to-page-id")), number(length), digest,
            payload if self.payload == "full" else None,
        )


def number(value: str | None) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


def block_length(headers: dict) -> int:
    return max(0, number(headers.get("content-length")) or 0)


def parse_headers(data: bytes) -> tuple[dict | None, int]:
    """Header names in lower case, and where the block starts; None if the headers go on beyond ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None, 0
    out = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out, end + 4


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to: of equal payloads of ``min_bytes`` or more, all but the largest page_id revisit it.

    Rows that share the largest id are responses, and so are rows whose payload has no id at all. Only digests
    that occur twice are joined back; they are broadcast if few, so payloads are not shuffled.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("many"))
    same = small(materialize(same.filter("many > 1").select(F.col("digest").alias("d"), "last"), "payloads"))
    joined = rows.join(same, F.col("digest") == F.col("d"), "left_outer")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 6) -> None:
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").option("level", str(level)).save(path)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read the records back, payloads checked but not returned."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return spark.read.format("warc").option("payload", "digest").load(path)
