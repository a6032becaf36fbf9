"""WARC archives: written and read with Spark, revisits resolved by payload digest.

Archives are gzip text files of WARC/1.1 records; the files' line separator is the blank lines that close a record, so
Spark's text writer lays records down as they are. Reading goes by Content-Length alone, so a payload may hold anything,
another record's headers included. A record has an HTTP block; its payload digest covers the payload.

``deduplicate`` reads archives, shuffles headers (never payloads) by digest and length, chooses one response per
payload, and rewrites every archive with fresh headers: the other records become revisits without a payload. The decisions
of one archive travel to it as one row, so the archive's compressed bytes are moved, not its records.
``resolve`` joins revisits with the responses that they refer to.

Cases: null html is an empty payload; payloads below 1000 bytes are never revisited. A null page id is no largest id; if all
records of a payload have none, one of them is the response and the revisits refer to null. Of rows with the same
payload and id the one with the smallest record id is the response, and the others refer to that same page id. Null
urls have no WARC-Target-URI; control characters and spaces in a url are percent-encoded. Revisits whose response is not in
the archives are kept with null refers_to, and the digest and length that their own headers give. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.session import fresh_path, pin

SMALLEST = 1000
ARCHIVE_BYTES = 32 << 20
_END = "\r\n\r\n"
_BATCH_BYTES = 4 << 20

_HEADERS = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_record string, refers_to_page long, date string"


def _lines(*parts: Column | str | None) -> Column:
    """Header lines; a null part leaves its line out."""
    return F.concat_ws("\r\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def clean_uri(url: Column) -> Column:
    """A url that fits on a header line: control characters and spaces are percent-encoded."""
    out = url
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(out, r"[\x00-\x1F\x7F]", "%3F")


def response_text(page_id: Column, url: Column, payload: Column, record_id: Column, date: str) -> Column:
    """A response record (without the blank lines that close it)."""
    length = F.octet_length(payload)
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(_END), payload)
    head = _lines(
        "WARC/1.1", "WARC-Type: response", _line("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))), f"WARC-Date: {date}", _line("WARC-Target-URI", clean_uri(url)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload))), _line("X-Page-Id", page_id), _line("X-Payload-Length", length),
        "Content-Type: application/http; msgtype=response", _line("Content-Length", F.octet_length(block)))
    return F.concat(head, F.lit(_END), block)


def write_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one response record per row to a new folder of archives."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    record_id = F.concat(F.lit("urn:row:"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("record_id", record_id)
    size = rows.agg(F.coalesce(F.avg(F.octet_length("payload")), F.lit(0.0))).first()[0]
    text = response_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("record_id"), date)
    path = fresh_path(spark, "warc-crawl")
    per_file = max(1, int(archive_bytes / (size + 400)))
    rows.select(text.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], int, int]]:
    """(first byte of the block, headers, first payload byte, byte after the payload) of the records of an unpacked archive."""
    at, size = 0, len(data)
    while at < size:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= size:
            break
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = head_end + 4
        stop = start + int(headers["content-length"])
        if headers.get("content-type", "").startswith("application/http"):
            http_end = data.find(b"\r\n\r\n", start, stop)
            start_payload = http_end + 4 if http_end >= 0 else stop
        else:
            start_payload = start
        yield start, headers, start_payload, stop
        at = stop


def _unpack(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _header_row(headers: dict[str, str]) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    digest = headers.get("warc-payload-digest", "")
    return (
        headers["warc-record-id"].strip("<>"), headers.get("warc-type"), number("x-page-id"), headers.get("warc-target-uri"), digest.partition(":")[2] or None,
        number("x-payload-length"), headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, number("x-refers-to-page"), headers.get("warc-date"),
    )


_HEADER_NAMES = [part.split()[0] for part in _HEADERS.split(", ")]
_HEADER_TYPES = [pa.int64() if part.endswith("long") else pa.string() for part in _HEADERS.split(", ")]


def _header_batch(rows: list[tuple]) -> dict[str, pa.Array]:
    columns = list(zip(*rows)) if rows else [()] * len(_HEADER_NAMES)
    return {n: pa.array(c, t) for n, c, t in zip(_HEADER_NAMES, columns, _HEADER_TYPES)}


def _file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(archive, headers of each record); payload digest and length are taken from payloads where a record has one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = _unpack(content.as_buffer().to_pybytes())
                rows = []
                for _, headers, start, stop in records(data):
                    row = list(_header_row(headers))
                    if row[1] == "response":
                        row[4], row[5] = hashlib.sha1(memoryview(data)[start:stop]).hexdigest(), stop - start
                    rows.append(tuple(row))
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([_file_name(name.as_py())] * len(rows)), **_header_batch(rows)})
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([_file_name(name.as_py())] * len(rows)), **_header_batch(rows)})

    return _files(spark, path).mapInArrow(read, f"archive string, {_HEADERS}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")


def choose_responses(headers: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """(archive, record_id, target record, target page) for every response that shall become a revisit.

    Headers are grouped by payload, so the group of a frequent payload is pre-aggregated to one row per task.
    """
    rows = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= smallest))
    rows = rows.select("archive", "record_id", "page_id", "payload_digest", "payload_bytes", "url", "date")
    # The largest page id, then the smallest record id: record ids are compared by their negated number.
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), (-F.regexp_extract("record_id", r"(\d+)$", 1).cast("long")).alias("order"))
    best = rows.groupBy("payload_digest", "payload_bytes").agg(F.max_by(F.struct("record_id", "page_id", "url", "date"), rank).alias("best"), F.count(F.lit(1)).alias("copies"))
    best = best.where("copies > 1").select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "best")
    joined = rows.join(best, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")))
    return joined.where(F.col("record_id") != F.col("best.record_id")).select(
        "archive", "record_id", F.col("best.record_id").alias("target_record"), F.col("best.page_id").alias("target_page"), F.col("best.url").alias("target_url"), F.col("best.date").alias("target_date"))


def deduplicate(spark: SparkSession, path: str, smallest: int = SMALLEST, date: str = "2024-01-02T00:00:00Z") -> str:
    """Rewrite the archives of a folder to a new one, with revisit records for repeated payloads."""
    headers = pin(read_headers(spark, path), "warc-headers")
    decisions = choose_responses(headers, smallest)
    per_archive = decisions.groupBy("archive").agg(F.collect_list(F.struct("record_id", "target_record", "target_page", "target_url", "target_date")).alias("decisions"))
    files = _files(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = files.join(per_archive, F.col("name") == F.col("archive"), "left").select("content", "decisions")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column("content"), batch.column("decisions")):
                targets = {d["record_id"]: d for d in found.as_py()} if found.is_valid else {}
                data = _unpack(content.as_buffer().to_pybytes())
                out, held = [], 0
                for block, headers, start, stop in records(data):
                    text = _fresh(data, headers, block, start, stop, targets, date)
                    out.append(text)
                    held += len(text)
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})

    to = fresh_path(spark, "warc-deduplicated")
    joined.mapInArrow(rewrite, "value string").write.option("lineSep", _END).option("compression", "gzip").text(to)
    return to


def _fresh(data: bytes, headers: dict[str, str], block_start: int, start: int, stop: int, targets: dict[str, dict], date: str) -> bytes:
    """A record with fresh headers; a revisit of ``targets`` keeps its HTTP headers and loses its payload."""
    record = headers["warc-record-id"].strip("<>")
    lines = ["WARC/1.1"]
    target = targets.get(record)
    kind = "revisit" if target else headers["warc-type"]
    lines += [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {headers.get('warc-date', date)}"]
    for name, label in (("warc-target-uri", "WARC-Target-URI"), ("warc-payload-digest", "WARC-Payload-Digest"), ("x-page-id", "X-Page-Id"), ("x-payload-length", "X-Payload-Length")):
        if name in headers:
            lines.append(f"{label}: {headers[name]}")
    if target:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{target['target_record']}>"]
        if target["target_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {target['target_url']}")
        if target["target_date"] is not None:
            lines.append(f"WARC-Refers-To-Date: {target['target_date']}")
    elif "warc-refers-to" in headers:
        lines += [f"WARC-Profile: {headers.get('warc-profile', '')}", f"WARC-Refers-To: {headers['warc-refers-to']}"]
    block = data[block_start:start if target else stop]
    lines += [f"WARC-Rewrite-Date: {date}", f"Content-Type: {headers.get('content-type', 'application/octet-stream')}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def resolve(headers: DataFrame) -> DataFrame:
    """One row per record; a revisit gets digest, length and page of the response it refers to."""
    responses = headers.where("record_type = 'response'")
    revisits = headers.where("record_type = 'revisit'").select("record_id", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to_record")
    # Many revisits may refer to one response: every response that is referred to is found once per task.
    targets = responses.select(F.col("record_id").alias("_record"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    found = revisits.join(targets, (F.col("payload_digest") == F.col("_digest")) & (F.col("refers_to_record") == F.col("_record")), "left")
    found = found.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(found)
