"""WARC archives: written as records by Spark's own file writer, read back by length, joined into captures.

Every page becomes a request, a response or revisit, and a metadata record; the first and last name the
response in WARC-Concurrent-To. Pages whose payload of at least ``REVISIT_BYTES`` equals that of a page
with a larger id are revisits of it. Files are whole-file gzip members that Spark commits, so a retried
task never leaves half a file; larger pages go to files of fewer records (``FILE_CLASSES``).
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
# pages of at most so many bytes, and records of such pages a file: no file holds much more than 50 MB, or twelve pages
FILE_CLASSES = ((1 << 14, 3000), (1 << 18, 200), (None, 12))
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "named_digest string, fields map<string,string>, http_head string, payload binary, payload_bytes long, payload_digest string"
)


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    """A stable identifier from the page, its payload and the kind of record."""
    key = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cuts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as page_id, url, html (null: empty), digest, original: the page that it revisits, or null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    small = rows.filter(F.octet_length("html") >= least).select("page_id", "digest", F.octet_length("html").alias("size"))
    groups = small.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    again = small.join(groups, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("original")))
    again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "original").distinct()
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").drop("id", "of")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> None:
    """Three records per row of ``pages`` (page_id, url, html) into gzip archives below ``folder``.

    A null url has no target line; line ends in a url are percent-encoded. Repeated rows repeat their records.
    """
    rows = with_revisits(pages, least)
    page, digest = F.col("page_id"), F.col("digest")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    own = record_id("response", page, digest)
    revisit = F.col("original").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(BREAK * 2))
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK * 2))
    facts = F.concat(F.coalesce(F.concat(F.lit("pageId: "), page.cast("string"), F.lit(BREAK)), F.lit("")), F.lit("payloadBytes: "), F.octet_length("html").cast("string"), F.lit(BREAK))

    def lines(kind: str, identity: Column, content: str, *more: tuple[str, Column | str]) -> list[tuple[str, Column | str]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", DATE), *more, ("Content-Type", content)]

    def targeted(record: Column) -> Column:
        return F.when(F.col("url").isNull(), record).otherwise(F.replace(record, F.lit("WARC-Date: "), F.concat(target, F.lit(BREAK + "WARC-Date: "))))

    payload_digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))
    original = record_id("response", F.col("original"), digest)
    answer = F.when(
        revisit,
        F.concat(targeted(_record_head(lines("revisit", own, "application/http;msgtype=response", payload_digest, ("WARC-Profile", PROFILE), ("WARC-Refers-To", original)), F.octet_length(head))), head),
    ).otherwise(
        F.concat(targeted(_record_head(lines("response", own, "application/http;msgtype=response", payload_digest), F.octet_length(head) + F.octet_length("html"))), head, F.col("html"))
    )
    asked = F.concat(targeted(_record_head(lines("request", record_id("request", page, digest), "application/http;msgtype=request", ("WARC-Concurrent-To", own)), F.octet_length(request))), request)
    noted = F.concat(targeted(_record_head(lines("metadata", record_id("metadata", page, digest), "application/warc-fields", ("WARC-Concurrent-To", own)), F.octet_length(facts))), facts)
    records = rows.select(F.octet_length("html").alias("size"), F.explode(F.array(asked, answer, noted)).alias("value"))
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    over, mode = -1, "errorifexists"
    for limit, count in FILE_CLASSES:
        part = records.filter(F.col("size") > over) if limit is None else records.filter((F.col("size") > over) & (F.col("size") <= limit))
        if over < largest or over < 0:
            part.select("value").write.mode(mode).option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", count).text(folder)
        over, mode = limit, "append"


def _record_head(headers: list[tuple[str, Column | str]], size: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), size.cast("string")))
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case headers, block) of every record of an archive: plain or gzip of one or many members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, str] = {}
        name = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:
                headers[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[start : start + size]
        at = start + size


def _parsed(with_payload: bool):
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", RECORD_SCHEMA)]
    text = pa.string()
    kinds = [text] * 8 + [pa.map_(text, text), text, pa.binary(), pa.int64(), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [_row(headers, block, with_payload) for headers, block in parse_records(content.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _row(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = h.get("warc-type")
    head, payload, fields = None, None, None
    if h.get("content-type", "").startswith("application/http"):
        top, gap, rest = block.partition(b"\r\n\r\n")
        head = (top + gap).decode("utf-8", "replace")
        payload = rest if kind == "response" else None
    elif h.get("content-type", "").startswith("application/warc-fields"):
        parts = [line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if line]
        fields = [(k.strip(), v.strip()) for k, _, v in parts]
    size = None if payload is None else len(payload)
    digest = None if payload is None else hashlib.sha1(payload).hexdigest()
    named = h.get("warc-payload-digest")
    named = named.partition(":")[2] if named else None
    return (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), named, fields, head, payload if with_payload else None, size, digest)


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``folder``; payloads can be left out once digested."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(_parsed(with_payload), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, response, request, metadata, payload_bytes, payload_digest.

    Responses and revisits are joined with the request and metadata records that name them in
    WARC-Concurrent-To; a capture without one has null there, and a record that names no capture is
    left out. A revisit takes size and digest of the full payload from the response that it refers to.
    Records with the same identifier are one record; ``copies`` counts those of the response.
    """
    columns = [c for c in records.columns if c not in ("record_id",)]
    one = F.first(F.struct(*columns)).alias("r")
    answers = records.filter(F.col("record_type").isin("response", "revisit")).groupBy("record_id").agg(one, F.count("*").alias("copies"))

    def linked(kind: str) -> DataFrame:
        rows = records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "target_uri", "date", "http_head")).alias(kind), F.first("fields").alias(f"{kind}_fields"))

    full = answers.select(F.col("record_id").alias("full_id"), F.col("r.payload_bytes").alias("full_bytes"), F.col("r.payload_digest").alias("full_digest")).filter("full_bytes is not null")
    rows = answers.join(linked("request").drop("request_fields"), "record_id", "left").join(linked("metadata"), "record_id", "left")
    # only revisits are joined: a column that most captures lack would send them all to one task
    revisits = rows.filter("r.refers_to is not null").join(full, F.col("r.refers_to") == F.col("full_id"), "left").drop("full_id")
    others = rows.filter("r.refers_to is null").withColumns({"full_bytes": F.lit(None).cast("long"), "full_digest": F.lit(None).cast("string")})
    return revisits.unionByName(others).select(
        F.col("record_id").alias("capture_id"), "copies", F.col("r").alias("response"), "request", "metadata", "metadata_fields",
        F.coalesce("r.payload_bytes", "full_bytes").alias("payload_bytes"), F.coalesce("r.payload_digest", "full_digest").alias("payload_digest"),
    )
