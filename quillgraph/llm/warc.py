"""WARC archives as a Spark data source, in Python.

Each record is one gzip member with the "sl" extra field of the WARC standard's annex: the member's compressed
and full length. A reader plans files into partitions, inflates a record's header block first, tests the record
type and header predicates that were pushed down (``record_type``, ``target_uri`` and ``record_id``, compared
or listed), and jumps over a payload that no one asks for without inflating it. Members without that field and records
that are not compressed are read too. Files are opened where they lie, through Arrow's file systems, and read in blocks
that records share.

Writing: each task writes one archive under a temporary name; the driver's commit moves the finished ones into
place, so that failed or repeated tasks leave nothing behind.

Defined results: a null payload is written as an empty one, a null uri or field as no header, a missing WARC-Date as the
time of writing; line ends inside a header value become spaces; an empty table gives an archive without records; files
named ``*.warc.gz`` or ``*.warc`` are read at any depth, others are not; page ids may have any type that a string can be
cast to, and a null one comes back as null.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import new_path

READ_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, headers map<string,string>, payload binary"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}
BATCH_BYTES = 4 << 20
BLOCK = 64 << 10
READ = 1 << 20
#: Fixed value: the standard's name of revisits with an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path and the path in it; Hadoop's names of S3 are known."""
    head, mark, tail = path.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{tail}" if mark and head in ("s3a", "s3n") else path)


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its lengths in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4BI2BH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None), f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcSource(DataSource):
    """Options: ``path``; for reading ``payload`` (true or false) and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "quill_warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.wants = options["path"], options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] in FIELDS and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.only.get(f.attribute[0])
                self.only[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together."""
        store, root = opened(self.path)
        inside = store.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda x: any(part[:1] in "_." for part in x.path.removeprefix(root).strip("/").split("/"))
        found = sorted((x for x in inside if x.is_file and x.path.endswith((".warc.gz", ".warc")) and not hidden(x)), key=lambda x: (-x.size, x.path))
        groups, room = [], 0
        for x in found:
            if not groups or room < x.size:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(x.path)
            room -= x.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for headers, payload in records(file, self.wants, lambda h: all(h.get(FIELDS[k]) in v for k, v in self.only.items())):
                    rows.append((headers, payload))
                    held += len(payload or b"") + 200
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
        columns = [pa.array([h.get(key) for h, _ in rows], pa.string()) for key in FIELDS.values()]
        columns += [pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([p for _, p in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*FIELDS, "headers", "payload"])


class Blocks:
    """A file's bytes by place, read a block at a time; nothing is read that no one asks for beyond a block."""

    def __init__(self, file) -> None:
        self.file, self.size, self.start, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``."""
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, READ))
        return self.held[at - self.start : at - self.start + n]


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(file, wants: bool, fits) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers with lower-case names, payload or None) of the records whose headers fit."""
    blocks, at = Blocks(file), 0
    while at < blocks.size:
        headers, payload, at = (_member if blocks.get(at, 2) == b"\x1f\x8b" else _plain)(blocks, at, wants, fits)
        if headers is not None:
            yield headers, payload


def _plain(blocks: Blocks, at: int, wants: bool, fits) -> tuple[dict[str, str] | None, bytes | None, int]:
    n = BLOCK
    while (head := (data := blocks.get(at, n)).find(b"\r\n\r\n")) < 0:
        if at + n >= blocks.size:
            raise ValueError(f"the record at byte {at} ends within its headers")
        n *= 2
    headers = _headers(data[:head])
    length = int(headers["content-length"])
    end = at + head + 4 + length
    if end > blocks.size:
        raise ValueError(f"the record at byte {at} is cut short")
    good = fits(headers)
    return headers if good else None, blocks.get(at + head + 4, length) if good and wants else None, end + 4


def _member(blocks: Blocks, at: int, wants: bool, fits) -> tuple[dict[str, str] | None, bytes | None, int]:
    start, length = blocks.get(at, 20), None
    if start[3] & 4 and start[12:14] == b"sl":
        length = struct.unpack_from("<I", start, 16)[0]
    inflate = zlib.decompressobj(31)
    rest = blocks.get(at, min(length or BLOCK, BLOCK))
    data, fed = b"", len(rest)

    def more() -> bytes:
        nonlocal fed
        found = blocks.get(at + fed, BLOCK) if at + fed < blocks.size else b""
        fed += len(found)
        return found

    while (head := data.find(b"\r\n\r\n")) < 0:  # 4096 bytes at a time
        rest = rest or more()
        if not rest or inflate.eof:
            raise ValueError(f"the record at byte {at} ends within its headers")
        data += inflate.decompress(rest, 4096)
        rest = inflate.unconsumed_tail
    headers = _headers(data[:head])
    good = fits(headers)
    if length is not None and not (good and wants):
        return headers if good else None, None, at + length
    parts = [data]
    while not inflate.eof:
        rest = rest or more()
        if not rest:
            raise ValueError(f"the record at byte {at} is cut short")
        parts.append(inflate.decompress(rest))
        rest = inflate.unconsumed_tail
    end = at + fed - len(inflate.unused_data)
    if length is not None and end != at + length:
        raise ValueError(f"the record at byte {at} is not as long as it says")
    body = b"".join(parts)[head + 4 :][: int(headers["content-length"])] if good and wants else None
    return headers if good else None, body, end


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, refers_to, headers (further ones), payload."""

    def __init__(self, options) -> None:
        self.path, self.level, self.draft = options["path"], int(options.get("level", 3)), f"_draft-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(f"{root}/{self.draft}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        with store.open_output_stream(f"{root}/{self.draft}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*[batch.column(c) for c in (*FIELDS, "headers", "payload")], strict=True):
                    *named, more, payload = [x.as_py() for x in row]
                    headers = [("WARC-Record-ID", named[0]), ("WARC-Type", named[1]), ("WARC-Target-URI", named[2]), ("WARC-Refers-To", named[3]), *(more or [])]
                    if not any(k.lower() == "warc-date" for k, _ in headers):
                        headers.append(("WARC-Date", now))
                    out.write(member(record(headers, payload or b""), self.level))
        return Written(name)

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{root}/{self.draft}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.draft}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.draft}")


def write_warc(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("quill_warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records as READ_SCHEMA. Spark pushes filters to Python sources only if the session says so: it does from here on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("quill_warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Write a record a page (page_id, url, html) to ``path``: of pages with equal payloads of at least
    ``min_bytes`` the smallest page_id is the response, others revisit it and carry no payload.

    Equal payloads are found by SHA-256. Only digests that occur twice enter the join's small side; a digest
    with any share of the pages is one row there, and adaptive execution splits its partition on the other.
    A row that repeats the response's page_id is a response too; rows without page_id revisit the smallest one.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.encode(body, "UTF-8").alias("payload"), F.sha2(body, 256).alias("digest"))
    large = F.octet_length("payload") >= min_bytes
    digests = pages.select("page_id", F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    firsts = digests.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(firsts, (rows["digest"] == firsts["_digest"]) & large, "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")))
    facts = [F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.col("digest")), F.lit("WARC-Payload-Length"), F.octet_length("payload").cast("string")]
    profile = [F.lit("WARC-Profile"), F.when(again, SAME_PAYLOAD)]
    write_warc(
        joined.select(
            urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
            urn(F.when(again, F.col("_first"))).alias("refers_to"), F.create_map(*facts, *profile).alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
        ),
        path,
    )


def page_records(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages with ids of type
    ``kind``. Responses are read with their payloads, which give their facts; of revisits the headers alone are read."""
    header = lambda k: F.try_element_at("headers", F.lit(k))
    named = lambda urn: F.url_decode(F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)
    both = (named("record_id").alias("page_id"), "record_type", named("refers_to").alias("refers_to"))
    whole = read_warc(spark, path).where(F.col("record_type") == "response").select(*both, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    bare = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    bare = bare.select(*both, header("warc-payload-length").cast("long").alias("payload_bytes"), F.regexp_extract(header("warc-payload-digest"), r"^sha256:(\w+)$", 1).alias("payload_digest"))
    return whole.unionByName(bare).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive_pages(pages, path, min_bytes)
    return page_records(spark, path, pages.schema["page_id"].dataType.simpleString())
