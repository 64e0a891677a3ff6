"""WARC archives with revisit records: one response for each payload, the rest refer to it."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shorter payloads are always written out.
MIN_BYTES = 1000
#: Records in one archive file.
RECORDS_PER_FILE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page, digest):
    h = F.md5(F.concat_ws("\n", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _line(name: str, value):
    """A header line, or null (left out) where the value is null; line ends inside a value are percent-encoded."""
    return F.concat(F.lit(name + ": "), F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, body, n, digest, record_type, original (page_id), original_url of every page.

    Headers are grouped by payload digest and length; of equal payloads of at least ``min_bytes`` the largest page_id is the
    response, all rows that repeat that page_id included. A page_id of null is a response unless another page has the
    payload. Only groups of several pages are joined back, so most payloads meet no partner.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    groups = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("m"))
    groups = groups.where("m > 1 and top.page_id is not null").select("digest", "n", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))
    joined = rows.join(groups, ["digest", "n"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "body", "n", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("original")).alias("original"), F.when(again, F.col("original_url")).alias("original_url"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_BYTES,
                   records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Write one WARC/1.1 record for every page (page_id, url, html) under ``path`` with new headers.

    A null html is an empty payload, a null url leaves its line out. Other columns are ignored; no pages, no records.
    Records end with CR LF CR LF, which is the line separator of the text files that Spark commits, so a task that is run
    again leaves no half archives. ``compression``: gzip (a file is one gzip member) or none.
    """
    r = resolve(pages, min_bytes)
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(response, F.col("n")).otherwise(F.lit(0))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")), _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~response, _line("WARC-Profile", F.lit(PROFILE))),
        F.when(~response, _line("WARC-Refers-To", _record_id(F.col("original"), F.col("digest")))),
        F.when(~response, _line("WARC-Refers-To-Target-URI", F.col("original_url"))),
        F.when(~response, _line("WARC-Refers-To-Date", F.lit(date))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")))
    record = F.concat(head, F.lit("\r\n\r\n"), http, F.when(response, F.col("body").cast("string")).otherwise(F.lit("")))
    r.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def records(data: bytes):
    """(header dict, block) of every record of an archive, gzipped or not; the declared lengths say where a block ends."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if len(block) < size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record is cut off at byte {at}")
        at += 4
        yield head, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, digest, refers_to (record id), payload of every record under ``path``."""
    names = ["record_id", "record_type", "page_id", "url", "digest", "refers_to", "payload"]

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in records(data.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None
                    page = head.get("X-Page-ID")
                    rows.append((head["WARC-Record-ID"], head["WARC-Type"], None if page is None else int(page), head.get("WARC-Target-URI"),
                                 head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To"), payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "record_id string, record_type string, page_id long, url string, digest string, refers_to string, payload binary")


def resolved_payloads(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id): what the archive holds for every page, a
    revisit seen through the response that it refers to. Length and digest are those of the stored payload."""
    own = archive.select("record_id", "page_id", "record_type", F.col("refers_to").alias("wanted"),
                         F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    found = own.where("record_type = 'response'").groupBy("record_id").agg(
        F.first("page_id").alias("at"), F.first("n").alias("rn"), F.first("sha").alias("rsha"))
    found = found.withColumnRenamed("record_id", "wanted")
    again = own.where("record_type = 'revisit'").join(found, "wanted", "left")
    return own.where("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).union(again.select("page_id", "rn", "rsha", "record_type", "at"))
