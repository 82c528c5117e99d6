"""WARC archives: write pages as records, read archives, assemble transactions.

Every page gives a request, a response or revisit, and a metadata record. Archives are text files whose records are framed by
Content-Length, written and committed by Spark, so any store that Spark reaches can hold them. Reading takes
whole files through the binary reader, unpacks and splits them record by record, and joins the records of a capture through
WARC-Concurrent-To into one nested row.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.staging import new_path, staged

from .common import load

MIN_REVISIT = 1000  # bytes from which an equal payload is a revisit
RECORDS_PER_FILE = 10_000
END = "\r\n\r\n"


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The pages with payload, payload_bytes, payload_digest and refers_to: of rows with equal payloads of ``min_bytes`` or
    more, the largest page_id; null for that row itself and for smaller or single payloads.

    Rows that share the largest page_id are all responses. A null page_id refers to the largest if there is one.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    firsts = (
        rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    # Written, so that both sides of the join are shuffled by digest and a hot payload can be split at run time.
    joined = rows.join(staged(firsts, "first_pages"), ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], mime: str, block: Column) -> Column:
    """One record as text, without its closing line ends; a header with a null value is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write request, response or revisit, and metadata records of all pages (page_id, url, html) to ``path``."""
    rows = revisits(pages, min_bytes)
    unique = F.monotonically_increasing_id().cast("string")
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "payload_digest", unique).cast("binary"))
    rows = rows.withColumn("name", name)

    def record_id(kind: str) -> Column:
        h = F.md5(F.concat(F.lit(kind), F.col("name")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)), F.lit(">"))

    url = F.regexp_replace(F.col("url"), r"[\r\n]+", " ")
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url), ("WARC-Page-ID", F.col("page_id").cast("string"))]
    ids = {k: F.col(f"{k}_id") for k in ("capture", "request", "metadata")}
    rows = rows.withColumns({f"{k}_id": record_id(k) for k in ids})
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"), ids["capture"],
        [*shared, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
         ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"))],
        "application/http; msgtype=response", F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1), F.lit(""))
    request = _record("request", ids["request"], [*shared, ("WARC-Concurrent-To", ids["capture"])], "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    metadata = _record("metadata", ids["metadata"], [*shared, ("WARC-Concurrent-To", ids["capture"])], "application/warc-fields",
                       F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(stream):
    """(headers, block) of each record of an uncompressed stream. Framing is by Content-Length alone."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        for line in iter(stream.readline, b"\r\n"):
            if not line:
                raise ValueError("record ends in its header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("record ends in its block")
        yield headers, block


RECORDS = (
    "record_id string, record_type string, concurrent_to string, target_uri string, page_id long, refers_to long, "
    "payload_bytes long, payload_digest string, http_header string, block binary"
)


def _row(headers: dict, block: bytes, with_block: bool) -> tuple:
    kind = headers.get("warc-type")
    number = lambda name: int(headers[name]) if headers.get(name, "").lstrip("-").isdigit() else None
    http, size, digest, rest = None, None, None, block
    if kind in ("response", "revisit", "request"):
        head, _, rest = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    if kind == "response":
        size, digest = len(rest), hashlib.sha1(rest).hexdigest()
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if named and named != digest:
            raise ValueError(f"{headers.get('warc-record-id')}: payload does not have the digest {named}")
    elif kind == "revisit":
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        for line in (http or "").split("\r\n"):
            if line.lower().startswith("content-length:"):
                size = int(line.split(":", 1)[1])
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), number("warc-page-id"),
        number("warc-refers-to-page-id"), size, digest, http, rest if with_block else None,
    )


def read_archives(spark, path: str, with_block: bool = True) -> DataFrame:
    """One row per record of all archives (gzip or plain) in a folder. A file is read by one task, record by
    record; a payload that does not have its digest, or a torn record, stops the read."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                raw = io.BytesIO(batch.column(0)[k].as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, size = [], 0
                for headers, block in parse_records(gzip.GzipFile(fileobj=raw) if packed else raw):
                    rows.append(_row(headers, block, with_block))
                    size += len(block) if with_block else 1000
                    if size > 1 << 23:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit record): capture, requests, metadata.

    Requests and metadata belong to the capture that they name as concurrent; a capture without any has empty arrays.
    Records that name no capture are in ``unattached``.
    """
    captures = records.filter(F.col("record_type").isin("response", "revisit"))
    others = records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    fields = F.struct("record_id", "record_type", "target_uri", "http_header", "block")
    rows = captures.select(F.col("record_id").alias("key"), F.struct(*captures.columns).alias("capture"))
    parts = others.groupBy(F.col("concurrent_to").alias("key")).agg(F.collect_list(fields).alias("parts"))
    joined = rows.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.array()))
    pick = lambda kind: F.filter("parts", lambda p: p.record_type == kind)
    return joined.select("capture", pick("request").alias("requests"), pick("metadata").alias("metadata"))


def unattached(records: DataFrame) -> DataFrame:
    """Request and metadata records whose concurrent-to names no capture of the table."""
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to")).distinct()
    return records.filter(F.col("record_type").isin("request", "metadata")).join(captures, "concurrent_to", "left_anti")


def round_trip(pages: DataFrame, with_block: bool = True) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and assemble the transactions.

    A null html is an empty payload, a null url or page_id leaves its header out, repeated rows are captures of their
    own, an empty table gives no rows. Other columns than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), path)
    return transactions(read_archives(spark, path, with_block))


def query(spark, sf_dir: str) -> DataFrame:
    t = round_trip(load(spark, sf_dir, "pages"), with_block=False)
    return t.select(
        "capture.page_id", "capture.payload_bytes", "capture.payload_digest", "capture.record_type", "capture.refers_to",
        F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to, 1 AS n_requests, 1 AS n_metadata
FROM p LEFT JOIN m USING (payload_digest, payload_bytes)
"""
