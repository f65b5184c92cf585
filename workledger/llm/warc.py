"""WARC archives of pages, written as segmented, chunked records and read back.

Writing. Every page becomes a record whose block is an HTTP response in chunked transfer framing. A block of
more than ``segment_chars`` characters is cut: the first part keeps the record's type, the others are
``continuation`` records that name its record id and a segment number; the last states the total length. Of
records with equal payloads of at least ``revisit_bytes``, the one with the largest page id carries the
payload, the others are ``revisit`` records that name it. Records are text (pages are UTF-8), so Spark's own
text writer makes the files, on any file system and with its commit protocol.

Reading. Archives are read as binary files, parsed by the lengths that records declare. Segments are grouped
by the origin's record id, put in order of their numbers, checked against the total length, and only then is
the chunked framing decoded. A missing segment, a wrong length or broken framing gives a named error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.llm.common import skew_join, written

CRLF = "\r\n"


@dataclass(frozen=True)
class WarcConfig:
    """Characters of a segment and of a chunk, and about how many characters of payload one archive holds."""

    segment_chars: int = 16_384
    chunk_chars: int = 4_096
    revisit_bytes: int = 1_000
    archive_chars: int = 8_000_000
    date: str = "2024-01-01T00:00:00Z"
    salts: int = 32
    compress: bool = True


def record_id(page_id: Column, part: Column) -> Column:
    """URN of a page's record or of one of its segments."""
    h = F.md5(F.concat_ws("/", F.lit("warc"), page_id.cast("string"), part.cast("string")).cast("binary"))
    groups = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _chunked(config: WarcConfig) -> Column:
    """``html`` in chunked transfer framing; chunks end between characters."""
    pieces = F.expr(
        f"transform(sequence(0, greatest(cast(ceil(char_length(html) / {config.chunk_chars}.0) as int) - 1, 0)),"
        f" i -> substring(html, i * {config.chunk_chars} + 1, {config.chunk_chars}))"
    )
    framed = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.concat(F.hex(F.octet_length(p)), F.lit(CRLF), p, F.lit(CRLF)),
    )
    return F.concat(F.array_join(framed, ""), F.lit("0" + CRLF + CRLF))


def _header(*fields: tuple[str, Column | str]) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        column = F.lit(value) if isinstance(value, str) else value
        parts.append(F.when(column.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), column, F.lit(CRLF))))
    return F.concat(*parts, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, config: WarcConfig = WarcConfig()) -> None:
    """``(page_id, url, html)`` -> archives under ``path``.

    A null html is an empty payload, a null url an empty one; line ends inside urls become spaces. Page ids
    must be there and differ: rows without one are not written, of rows that repeat one the first copy by
    payload digest is written.
    """
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    digests = written(
        rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size"))
        .groupBy("page_id")
        .agg(F.min(F.struct("digest", "size")).alias("d"))
        .select("page_id", "d.digest", "d.size"),
        "warc-digests",
    )
    owners = (
        digests.where(F.col("size") >= config.revisit_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("owner"))
        .where("copies > 1")
        .select("digest", "owner")
    )
    salt = F.pmod(F.xxhash64("page_id"), F.lit(config.salts))
    revisits = written(
        skew_join(
            digests.where(F.col("size") >= config.revisit_bytes).withColumn("k", F.concat_ws("/", "digest", salt)),
            owners.select("owner", F.explode(F.array([F.concat_ws("/", "digest", F.lit(i)) for i in range(config.salts)])).alias("k")),
            "k",
        )
        .where("page_id <> owner")
        .select("page_id", "owner"),
        "warc-revisits",
    )
    marks = written(
        digests.select("page_id", "digest").join(revisits, "page_id", "left").withColumnRenamed("page_id", "marked_id"), "warc-marks"
    )
    # the one place where payloads move
    marked = rows.join(marks.hint("shuffle_hash"), (F.col("page_id") == F.col("marked_id")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("digest")))
    shape = rows.agg(F.count("*").alias("n"), F.sum(F.char_length("html")).alias("chars")).head()
    if marks.count() < shape["n"]:  # some page ids repeat; equal copies are left here
        marked = marked.dropDuplicates(["page_id"])
    again = F.col("owner").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.when(again, CRLF).otherwise(F.concat(F.lit(f"Transfer-Encoding: chunked{CRLF}{CRLF}"), _chunked(config))),
    )
    size = config.segment_chars
    segments = marked.withColumn("http", http).select(
        "page_id",
        "url",
        "digest",
        "owner",
        F.octet_length("http").alias("total"),
        F.posexplode(
            F.expr(
                f"transform(sequence(0, cast(ceil(char_length(http) / {size}.0) as int) - 1),"
                f" i -> substring(http, i * {size} + 1, {size}))"
            )
        ).alias("at", "block"),
        F.ceil(F.char_length("http") / F.lit(float(size))).alias("segments"),
    )
    first, cut = F.col("at") == 0, F.col("segments") > 1
    number = F.when(cut, (F.col("at") + 1).cast("string"))
    kind = F.when(~first, "continuation").when(again, "revisit").otherwise("response")
    record = F.concat(
        _header(
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(F.col("page_id"), F.col("at"))),
            ("WARC-Date", config.date),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Page-ID", F.col("page_id").cast("string")),
            ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
            ("WARC-Refers-To", F.when(first & again, record_id(F.col("owner"), F.lit(0)))),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Origin-ID", F.when(~first, record_id(F.col("page_id"), F.lit(0)))),
            ("WARC-Segment-Total-Length", F.when(cut & (F.col("at") + 1 == F.col("segments")), F.col("total").cast("string"))),
            ("Content-Type", F.when(first, "application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.col("block"),
    )
    # records a file, so that a file holds about as many characters as one task should parse
    parts = shape["n"] + (shape["chars"] or 0) // config.segment_chars
    per_file = max(1, int(config.archive_chars * parts // max(shape["chars"] or 1, 1)))
    writer = segments.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file)
    (writer.option("compression", "gzip") if config.compress else writer).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
RECORD_SCHEMA = "record_id string, page_id long, url string, kind string, digest string, refers_to string, number int, origin string, total long, block binary"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("kind", pa.string()),
        ("digest", pa.string()),
        ("refers_to", pa.string()),
        ("number", pa.int32()),
        ("origin", pa.string()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)


def records_in(archive: bytes) -> Iterator[dict]:
    """Records of one archive, by their declared lengths."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        head = archive[at : end + 2]
        found = _LENGTH.search(head)
        if not found:
            raise ValueError(f"the record at byte {at} has no length")
        start, length = end + 4, int(found[1])
        fields = {}
        for line in head.split(b"\r\n")[1:-1]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        if archive[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "record_id": fields["warc-record-id"],
            "page_id": int(fields["warc-page-id"]) if "warc-page-id" in fields else None,
            "url": fields.get("warc-target-uri"),
            "kind": fields["warc-type"],
            "digest": fields.get("warc-payload-digest"),
            "refers_to": fields.get("warc-refers-to"),
            "number": int(number) if number else None,
            "origin": fields.get("warc-segment-origin-id"),
            "total": int(total) if total else None,
            "block": archive[start : start + length],
        }
        at = start + length + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[dict] = []
            archive = content.as_py()
            for row in records_in(gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive):
                rows.append(row)
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def dechunk(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(http: bytes) -> bytes:
    head, _, body = http.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "url", "kind", "refers_to", "payload", "payload_digest", "error"]
    for batch in batches:
        payloads, digests, errors = [], [], []
        blocks, totals, stated, kinds, whole = (
            batch.column(c).to_pylist() for c in ("block", "total", "digest", "kind", "whole")
        )
        for block, total, digest, kind, complete in zip(blocks, totals, stated, kinds, whole, strict=True):
            payload = error = None
            block = b"".join(block)  # its segments, in order
            if not complete:
                error = "missing segment"
            elif total is not None and total != len(block):
                error = "wrong total length"
            elif kind != "revisit":
                try:
                    payload = payload_of(block)
                except ValueError as broken:
                    error = str(broken)
            sha = hashlib.sha1(payload).hexdigest() if payload is not None else (digest or "").removeprefix("sha1:")
            if payload is not None and digest and digest != f"sha1:{sha}":
                error = "payload digest differs"
            payloads.append(payload)
            digests.append(sha)
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in names[:5]),
                pa.array(payloads, pa.binary()),
                pa.array(digests, pa.string()),
                pa.array(errors, pa.string()),
            ],
            names=names,
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives under ``path`` -> ``record_id, page_id, url, kind, refers_to, payload, payload_digest, error``.

    One row per logical record, its segments joined; a segment that is there twice counts once. ``payload`` is null for revisits and for records with an
    ``error``. Only cut records are shuffled. An archive is parsed whole by one task, so archives should be
    of bounded size, as ``write_archives`` makes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    records = files.select("content").mapInArrow(_parse, RECORD_SCHEMA)
    columns = ["record_id", "page_id", "url", "kind", "digest", "refers_to", "total", "block"]
    plain = records.where("number is null").select(*columns[:-1], F.array("block").alias("block"), F.lit(True).alias("whole"))
    parts = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    of_first = {c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "kind", "digest", "refers_to")}
    joined = (
        parts.groupBy(F.col("origin").alias("record_id"))
        .agg(
            *of_first.values(),
            F.max("total").alias("total"),
            F.max("number").alias("last"),
            F.array_distinct(F.array_sort(F.collect_list(F.struct("number", "block")))).alias("parts"),
        )
        .select(
            "record_id", "page_id", "url", "kind", "digest", "refers_to", "total",
            F.col("parts.block").alias("block"),
            F.expr("kind is not null and total is not null and size(parts) = last").alias("whole"),
        )
    )
    return plain.unionByName(joined.select(*columns, "whole")).mapInArrow(
        _decode,
        "record_id string, page_id long, url string, kind string, refers_to string, payload binary, payload_digest string, error string",
    )


def archived(pages: DataFrame, path: str, config: WarcConfig = WarcConfig()) -> DataFrame:
    """Write ``pages`` and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Revisits take length and digest from the record they refer to. ``refers_to`` is that record's page id.
    """
    spark = pages.sparkSession
    write_archives(pages, path, config)
    found = written(
        read_archives(spark, path).select(
            "record_id", "page_id", "kind", "refers_to", "payload_digest", "error",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "warc-read",
    )
    plain = found.where("refers_to is null")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(config.salts))
    again = found.where("refers_to is not null").withColumn("k", F.concat_ws("/", "refers_to", salt))
    asked = found.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    owners = (
        plain.join(asked, "record_id", "left_semi")
        .select(
            F.col("page_id").alias("owner"),
            F.col("payload_bytes").alias("owner_bytes"),
            F.col("payload_digest").alias("owner_digest"),
            F.explode(F.array([F.concat_ws("/", "record_id", F.lit(i)) for i in range(config.salts)])).alias("k"),
        )
    )
    resolved = skew_join(again, owners, "k", "left").select(
        "page_id",
        F.col("owner_bytes").alias("payload_bytes"),
        F.col("owner_digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        F.col("owner").alias("refers_to"),
        F.when(F.col("owner").isNull(), "revisited record is missing")
        .when(F.col("owner_digest") != F.col("payload_digest"), "revisited payload differs")
        .otherwise(F.col("error"))
        .alias("error"),
    )
    return plain.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        "error",
    ).unionByName(resolved)
