"""WARC archives: a writer of plain columns and a salvage reader.

Writing: a record is a string column (headers, an HTTP head, the payload), and Spark's text writer with
the record separator as line separator makes the archive, on any file system and with Spark's commit
protocol. Payloads are matched by their SHA-1: one aggregation over narrow rows names the digests that
occur more than once, and these meet the pages again (Spark broadcasts them while they are few, else the pages are
shuffled once). Files are bounded by bytes: records of at most SMALL bytes of html and url go RECORDS_A_FILE to a file, longer ones
fewer, the longest one to a file.

Reading: a data source of Spark's in Python deals files to tasks of about TASK_BYTES; a task reads a file in pieces of
PIECE bytes and holds one record, so archives may have any size (a file isn't cut, as only what comes before tells whether a
version line begins a record or lies in one). Archives on file systems that only Spark opens come as binary rows of 2 GB at most. A record must have a version line, well-formed headers, its whole
block and end marker, and matching digests; a gzip member must inflate to its trailer. After a failed
check the reader looks for the next member or version line, inside a member for the next version line of
its content, goes on there, and logs the bytes between as a quarantined gap. Of a damaged member it reads
what inflates up to the damage. A member is inflated as a whole: it is a record, as a rule.

Defined cases: a null html is an empty payload; a null url gives no target line; line breaks in urls
are percent-encoded; a null page_id is kept and refers to nothing if no page has an id; repeated rows
with the least page_id of their payload are all responses; very long urls and htmls make long records, up to Spark's 2 GB a
value; lengths of more than 18 digits are a fault of the record; further columns are ignored; an empty table gives an empty
result. A gap in the archives that the query itself wrote is an error, never a lost row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from canoply.sources import blocks

from .store import new_path, save, table, text_of

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SMALL, RECORDS_A_FILE = 1 << 17, 2000
TASK_BYTES, PIECE, ROWS = 64 << 20, 4 << 20, 1000
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSIONS, _MEMBER = (b"WARC/1.0\r\n", b"WARC/1.1\r\n"), b"\x1f\x8b\x08"
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")
SCHEMA = "kind string, path string, at long, length long, reason string, type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes make eight digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(value), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), _HEX, _B32)


def record_type(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with _payload, _digest and _refers (the page_id that a revisit refers to, else null)."""
    p = pages.withColumn("_payload", text_of(F.col("html"))).withColumn("_digest", base32_sha1(F.col("_payload")))
    counted = p.where(F.octet_length("_payload") >= least_bytes).groupBy(F.col("_digest").alias("_d")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    known = save(counted.where("_n > 1").select("_d", "_first"), "payloads")
    return p.join(known, F.col("_digest") == F.col("_d"), "left").withColumn("_refers", F.when(F.col("_first") != F.coalesce(F.col("page_id"), F.col("_first") - 1), F.col("_first"))).drop("_d", "_first")


def _lines(*pairs) -> Column:
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs))


def records(pages: DataFrame) -> DataFrame:
    """One string a page: the record without its end marker."""
    payload, refers = F.col("_payload"), F.col("_refers")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _lines(("Content-Length", F.octet_length(payload).cast("string"))), F.lit("\r\n"))
    block = F.concat(head, F.when(refers.isNull(), payload).otherwise(""))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    made = pages.select("page_id", "_digest", "_refers", uri.alias("_uri"), block.alias("_block"))
    headers = _lines(
        ("WARC-Type", F.when(refers.isNull(), "response").otherwise("revisit")),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("_uri")),
        ("WARC-Profile", F.when(refers.isNotNull(), REVISIT)),
        ("WARC-Refers-To", F.when(refers.isNotNull(), urn(refers))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("_block")))),
        ("Content-Length", F.octet_length("_block").cast("string")),
    )
    return made.select(F.concat(F.lit("WARC/1.0\r\n"), headers, F.lit("\r\n"), F.col("_block")).alias("value"))


def write(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE, small: int = SMALL) -> None:
    """Archives of pages (page_id, url, html) under path, in files of about small * records_a_file bytes at most, or of one record."""
    size = F.octet_length(text_of(F.col("html"))) + F.octet_length(text_of(F.col("url")))
    typed = record_type(pages.select("page_id", "url", "html"))
    most = pages.select(F.max(size).alias("n")).first().n or 0
    bounds = [small << k for k in range(0, 12, 3)]  # the classes that there are: one, unless there are long records
    for k, top in enumerate(bounds):
        if k == 0 or most > bounds[k - 1]:
            own = typed.where((size > (bounds[k - 1] if k else -1)) & ((size <= top) | F.lit(top == bounds[-1])))
            many = 1 if top == bounds[-1] else max(1, records_a_file >> 3 * k)
            records(own).write.option("lineSep", END).option("maxRecordsPerFile", many).mode("append").text(path)


class Ranged:
    """An open file as far as the reader needs bytes: slices, len, find and startswith. It holds the two pieces read last; what begins in one and ends behind it is read anew."""

    def __init__(self, file: pa.NativeFile, piece: int = PIECE):
        self.file, self.piece, self.size = file, piece, file.size()
        self.held: list[tuple[int, bytes]] = []

    def __len__(self) -> int:
        return self.size

    def _piece(self, at: int) -> tuple[int, bytes] | None:
        """The held piece where a place lies."""
        return next((x for x in self.held if x[0] <= at < x[0] + len(x[1])), None)

    def _load(self, at: int) -> tuple[int, bytes]:
        self.held = [(at, self.file.read_at(min(self.piece, self.size - at), at)), *self.held[:1]]
        return self.held[0]

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self.size)
        if lo >= hi:
            return b""
        got = self._piece(lo)
        if hi - lo > self.piece or got and hi > got[0] + len(got[1]):
            return self.file.read_at(hi - lo, lo)
        start, held = got or self._load(lo)
        return held[lo - start : hi - start]

    def startswith(self, what: tuple[bytes, ...] | bytes, at: int) -> bool:
        return self[at : at + 16].startswith(what)

    def find(self, what: bytes, at: int, end: int | None = None) -> int:
        end = self.size if end is None else min(end, self.size)
        while at < end:
            start, held = self._piece(at) or self._load(at)
            found = held.find(what, at - start, end - start)
            if found >= 0:
                return start + found
            if start + len(held) >= end:
                break
            at = max(at, start + len(held) - len(what) + 1)
            self._load(at)
        return -1


def ahead(data: bytes | Ranged, at: int, marks: tuple[bytes, ...], piece: int = PIECE // 4) -> int:
    """The first place from at on where one of the marks lies; the end of data if none does."""
    most = max(map(len, marks)) - 1
    while at < len(data):
        found = [x for x in (data.find(m, at, at + piece) for m in marks) if x >= 0]
        if found:
            return min(found)
        at += piece - most
    return len(data)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse(data: bytes | Ranged, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at a place: its end, headers and block, or what is wrong."""
    if not data.startswith(_VERSIONS, at):
        return "no version line"
    top = data.find(b"\r\n\r\n", at)
    if top < 0:
        return "headers do not end"
    headers = {}
    for line in data[at + 10 : top].split(b"\r\n"):
        m = _HEADER.fullmatch(line)
        if not m:
            return "malformed header"
        headers[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        return "no content length" if "content-length" not in headers else "bad content length"
    block_end = top + 4 + int(headers["content-length"])
    if data[block_end : block_end + 4] != b"\r\n\r\n":
        return "truncated block" if block_end + 4 > len(data) else "no end marker"
    block = data[top + 4 : block_end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        return "block digest differs"
    said = headers.get("warc-payload-digest", "")
    if said.startswith("sha1:") and headers.get("warc-type") != "revisit" and said[5:] != digest(payload_of(headers, block)[0]):
        return "payload digest differs"
    return block_end + 4, headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload in the block, and its full length (a revisit has only the length)."""
    if "application/http" not in headers.get("content-type", ""):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
    return payload, int(said[1]) if said and headers.get("warc-type") == "revisit" else len(payload)


def member(data: bytes | Ranged, at: int) -> tuple[int, bytes, str | None]:
    """The gzip member at a place: its end, what it inflates to up to any damage, and what is wrong."""
    inflate, out, pos, why = zlib.decompressobj(31), [], at, None
    step = 1 << 16
    while pos < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[pos : pos + step]))
            pos += step
        except zlib.error as e:
            if step == 1:
                why = f"member: {e}"
                break
            inflate, step = before, 1  # to the damage byte by byte
    if why is None and not inflate.eof:
        why = "truncated member"
    return min(pos, len(data)) - len(inflate.unused_data), b"".join(out), why


def inside(content: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The records in what a member inflates to, and the first thing that is wrong between them."""
    found, pos, why = [], 0, None
    while pos < len(content):
        one = parse(content, pos)
        if isinstance(one, str):
            why = why or one
            pos = ahead(content, pos + 1, _VERSIONS)
        else:
            found.append(one[1:])
            pos = one[0]
    return found, why


def salvage(data: bytes | Ranged) -> Iterator[tuple]:
    """('record', start, end, headers, block) and ('gap', start, end, reason), in order, over all bytes.

    A whole member with a bad record gives its other records and a gap over the same bytes.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        inner: list[tuple] = []
        wrong = None  # in a whole member
        if data.startswith(_MEMBER, at):
            end, content, got = member(data, at)
            inner, wrong = inside(content)
        else:
            one = parse(data, at)
            got = one if isinstance(one, str) else None
            if got is None:
                end = one[0]
                inner.append(one[1:])
        if got is not None:
            for headers, block in inner:  # whole records before the damage of this member
                yield "record", at, at, headers, block
            if bad is None:
                bad, why = at, got
            at = ahead(data, at + 1, (*_VERSIONS, _MEMBER))
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        for headers, block in inner:
            yield "record", at, end, headers, block
        if wrong is not None:
            yield "gap", at, end, wrong
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


_S, _I = pa.string(), pa.int64()
_KINDS = pa.schema(list(zip((x.split()[0] for x in SCHEMA.split(", ")), [_S, _S, _I, _I, _S, _S, _S, _S, _S, _S, _I, pa.binary()], strict=True)))


def rows_of(name: str, data: bytes | Ranged, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows of an archive, in batches of bounded rows and of about PIECE bytes of payload."""
    rows, have = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS.types, strict=True)], schema=_KINDS)

    for kind, start, end, *rest in salvage(data):
        if kind == "gap":
            rows.append((kind, name, start, end - start, rest[0], *[None] * 7))
        else:
            h, (payload, size) = rest[0], payload_of(*rest)
            rows.append((kind, name, start, end - start, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), size, payload if payloads else None))
            have += len(payload) * payloads
        if len(rows) >= ROWS or have >= PIECE:
            yield batch()
            rows, have = [], 0
    if rows:
        yield batch()


@dataclass
class Files(InputPartition):
    """Archives of one task."""

    files: list[str]


class Archives(DataSource):
    """Options: path (an URI of Arrow), payloads and task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "canoply_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payloads, self.task_bytes = options["path"], options["payloads"] == "true", int(options["task_bytes"])

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        have = self.task_bytes
        for path, size in blocks.files_under(self.path):
            if have + size > self.task_bytes:
                out.append(Files([]))
                have = 0
            out[-1].files.append(path)
            have += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as file:
                yield from rows_of(path, Ranged(file), self.payloads)


def read(spark: SparkSession, path: str, payloads: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under path."""
    uri = blocks.arrow_uri(spark, path)
    if uri:
        spark.dataSource.register(Archives)
        return spark.read.format(Archives.name()).options(payloads=str(payloads).lower(), task_bytes=task_bytes).load(uri)

    def batches(it):
        for b in it:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from rows_of(name, bytes(content.as_buffer()), payloads)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, SCHEMA)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    whole = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), "reason")).cast("boolean"))
    return read(spark, path).where(whole).select(
        page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to")
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  translate(array_to_string([to_base(('0x' || substr(hex, 1 + 10 * i, 10))::BIGINT, 32, 8) FOR i IN range(4)], ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""
