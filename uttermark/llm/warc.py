"""WARC archives as a Spark data source, for reading and writing.

Reading plans one Spark partition for each bundle of files, takes filters on record types
and headers down to the parser, reads a record's headers first, and passes over the
payload of every record that is filtered out or whose payload is not asked for: it is
neither kept, checked nor sent to Spark.

    spark.read.format("warc").option("path", folder).option("payload", "response").load()

Options: ``path`` (a file or a folder, on any file system that pyarrow opens),
``payload`` (``all``, ``none`` or record types, comma-separated), ``bundle_bytes``.

Defined cases: a page without html has an empty payload; one without url has no target
header; control characters and blanks of an url are percent-encoded. Of pages of equal
payload, all that carry the largest id are responses, the others revisit it; where all
ids are null, all are responses, and a null id beside others is a revisit.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import new_path, table, written
from .registry import query

BUNDLE_BYTES = 64 << 20
FILE_BYTES = 1 << 30
STEP = 1 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
}

SCHEMA = (
    ", ".join(f"{c} string" for c in HEADERS)
    + ", payload_bytes bigint, payload_valid boolean, payload binary"
)
ARROW = pa.schema(
    [(c, pa.string()) for c in HEADERS]
    + [("payload_bytes", pa.int64()), ("payload_valid", pa.bool_()), ("payload", pa.binary())]
)


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else "file://" + uri)


# Reading.


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    found, name = {}, None
    while (line := stream.readline().rstrip(b"\r\n").decode("utf-8", "replace")) != "":
        if line[0] in " \t" and name:  # a folded line goes on with the last header
            found[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _pass_over(stream: io.BufferedReader, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, STEP)))
        if not got:
            raise ValueError("archive ends within a record")
        n -= got


def read_records(stream, wanted, with_payload) -> Iterator[dict]:
    """Records whose headers are ``wanted``, as values of the schema. A payload is read
    only of the record types for which ``with_payload`` holds."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = _headers(stream)
        left = int(headers.get("content-length", 0))
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        if not wanted(row):
            _pass_over(stream, left)
            continue
        row |= {"payload_bytes": left, "payload": None, "payload_valid": None}
        if (row["content_type"] or "").startswith("application/http"):
            before = stream.tell()
            stream.readline()  # the status line
            inner = _headers(stream)
            left -= stream.tell() - before
            # A revisit has the HTTP headers of the payload that it leaves out.
            row["payload_bytes"] = int(inner.get("content-length", left))
        if with_payload(row["record_type"]):
            row["payload"] = stream.read(left)
            if len(row["payload"]) < left:
                raise ValueError("archive ends within a record")
            if row["payload_digest"]:
                row["payload_valid"] = payload_digest(row["payload"]) == row["payload_digest"]
        else:
            _pass_over(stream, left)
        yield row


@dataclass
class Bundle(InputPartition):
    paths: list[str]


def _test(f: Filter):
    """A test of a header column, or None if the filter is not one."""
    if len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    column = f.attribute[0]
    value = getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x == value,
        In: lambda x: x in value,
        IsNotNull: lambda x: True,
        StringStartsWith: lambda x: x.startswith(value),
        StringEndsWith: lambda x: x.endswith(value),
        StringContains: lambda x: value in x,
    }
    test = tests.get(type(f))
    return test and (lambda row: row[column] is not None and test(row[column]))


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bundle_bytes = int(options.get("bundle_bytes", BUNDLE_BYTES))
        self.payload = options.get("payload", "all").lower()
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if hasattr(f, "attribute") and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files, path = open_path(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(path, recursive=True))
        else:
            found = [info]
        found = [
            x
            for x in sorted(found, key=lambda x: x.path)
            if x.type == fs.FileType.File and not posixpath.basename(x.path).startswith(("_", "."))
        ]
        bundles, size = [], self.bundle_bytes
        for x in found:
            if size + x.size > self.bundle_bytes:
                bundles.append(Bundle([]))
                size = 0
            bundles[-1].paths.append(x.path)
            size += x.size
        return bundles or [Bundle([])]

    def read(self, partition):
        files, _ = open_path(self.path)
        tests = [_test(f) for f in self.filters]
        types = {t.strip() for t in self.payload.split(",")}
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, STEP)
                for row in read_records(
                    stream,
                    lambda row: all(t(row) for t in tests),
                    lambda kind: "all" in types or kind in types,
                ):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


# Writing.


@dataclass
class Staged(WriterCommitMessage):
    paths: list[str]


def record(row: dict) -> bytes:
    """One record. Takes record_id, record_type, target_uri, refers_to, date and payload;
    a revisit is given its payload too, of which only digest and length are written."""
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
    ]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {row['target_uri']}")
    lines.append(f"WARC-Payload-Digest: {payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own below ``_staged``; the commit moves the files
    of the attempts that count, so a lost or repeated task leaves nothing in the result."""

    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        files, path = open_path(self.path)
        staged = posixpath.join(path, "_staged")
        files.create_dir(staged, recursive=True)
        paths, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is not None and out.tell() >= self.file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        paths.append(posixpath.join(staged, f"{uuid.uuid4().hex}.warc.gz"))
                        out = files.open_output_stream(paths[-1], compression=None)
                    out.write(gzip.compress(record(row), 4, mtime=0))
        finally:
            if out is not None:
                out.close()
        return Staged(paths)

    def commit(self, messages):
        files, path = open_path(self.path)
        for message in messages:
            for p in message.paths if message else ():
                files.move(p, posixpath.join(path, posixpath.basename(p)))
        files.create_dir(path, recursive=True)
        if files.get_file_info(staged := posixpath.join(path, "_staged")).type != fs.FileType.NotFound:
            files.delete_dir(staged)

    def abort(self, messages):
        files, _ = open_path(self.path)
        for message in messages:
            for p in message.paths if message else ():
                if files.get_file_info(p).type == fs.FileType.File:
                    files.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def write_warc(records: DataFrame, path: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(path=path, **options).mode("append").save()


# Pages as records.

_ID = "<urn:x-page:{}>"


def page_urn(column):
    return F.format_string("<urn:x-page:%s>", F.coalesce(column.cast("string"), F.lit("null")))


def urn_page(column):
    return F.regexp_extract(column, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html). Among payloads of at least
    ``min_bytes`` that are equal, all but that of the largest page id become revisits.

    Only digests and ids are grouped; payloads do not move unless the table of repeated
    digests is too large to broadcast."""
    known = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    repeated = written(
        known.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha1", "first"),
        "repeated",
    )
    is_copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = F.regexp_replace("url", "%", "%25")
    for code in [*range(0x21), 0x7F]:
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return known.join(repeated, "sha1", "left").select(
        page_urn(F.col("page_id")).alias("record_id"),
        F.when(is_copy, "revisit").otherwise("response").alias("record_type"),
        uri.alias("target_uri"),
        F.when(is_copy, page_urn(F.col("first"))).alias("refers_to"),
        F.lit("2020-01-01T00:00:00Z").alias("date"),
        "payload",
    )


SQL = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
n AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1, 1)), '')
    AS payload_digest FROM d),
f AS (SELECT payload_digest, max(page_id) AS first FROM n GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM n JOIN f USING (payload_digest)
"""


@query("op1_warc_round_trip", SQL)
def op1(spark, sf_dir):
    path = new_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    archived = read_warc(spark, path, payload="response").filter(
        F.col("record_type").isin("response", "revisit")
    )
    # The payload that is read must be the one the header names.
    sound = F.col("payload_valid").isNull() | F.col("payload_valid")
    return archived.select(
        urn_page(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload"), "payload_bytes").cast("bigint").alias("payload_bytes"),
        F.when(sound, F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        "record_type",
        urn_page(F.col("refers_to")).alias("refers_to"),
    )
