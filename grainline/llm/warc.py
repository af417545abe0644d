"""WARC archives with revisit records.

Writing: only headers (digest, largest page_id, count) are shuffled by payload
digest to find the originals, combined map-side so that a hot payload is one
row a task; pages join them on the digest, the original becomes a
``response`` record and its copies ``revisit`` records without a payload.
Only digests that occur several times are joined; when these are at most
``BROADCAST_ORIGINALS`` they are broadcast and payloads are not shuffled at
all, beyond that the same join shuffles.
Spark's text writer puts one record a line with ``\\r\\n\\r\\n`` as line
separator, which is just what ends a WARC record; record ids are derived from
content, so a repeated task writes the same file.

Records are written in classes of similar size, each with its own number of
records a file, so that a file holds at most ``ARCHIVE_BYTES`` or one record.  Few
classes have rows (the headers tell); most pages are in the first.

Reading: an archive file is one row (``binaryFile``) and is cut by
Content-Length.  Revisits find their payload's length at the original by record
id.

Defined cases: NULL html is an empty payload; payloads shorter than
``MIN_BYTES`` are always responses; NULL page_ids are allowed (a NULL is the
smallest; if all copies have NULL they are all responses); rows that repeat
page_id and payload are all alike (all response or all revisit); line breaks
and spaces in a url are percent-encoded, a NULL url has no target header; an
empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.session import materialize, stage_path

MIN_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
#: What a record has besides its payload, about.
HEADER_BYTES = 700
BROADCAST_ORIGINALS = 500_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def _record_id(page: str, digest: str) -> F.Column:
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("")), F.col(digest)))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                          for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES,
                   compression: str = "none") -> None:
    """Write a record per row under ``path`` (a folder of archive files,
    ``compression`` none or gzip)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    headers = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"),
                                                     F.max("size").cast("long").alias("size")), "warc-headers")
    bounds = _size_classes(headers)
    originals = materialize(headers.filter((F.col("copies") > 1) & (F.col("size") >= min_bytes) & F.col("original").isNotNull())
                            .select("digest", "original"), "warc-originals")
    if originals.count() <= BROADCAST_ORIGINALS:
        originals = F.broadcast(originals)
    rows = rows.join(originals, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.col("size").cast("string"), F.lit(_END * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <"), _record_id("page_id", "digest"), F.lit(">")),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _record_id("original", "digest"), F.lit(">"))),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"))]
    record = F.concat(F.concat_ws(_END, *head), F.lit(_END * 2), F.col("block"))
    records = rows.withColumn("block", block).select("size", record.alias("record"))
    # an empty table is one empty file
    for k, (low, high) in enumerate(bounds or [(-1, 0)]):
        (records.filter((F.col("size") > low) & (F.col("size") <= high)).select("record")
         .write.mode("append" if k else "overwrite").option("lineSep", _END * 2)
         .option("maxRecordsPerFile", max(1, archive_bytes // (high + HEADER_BYTES))).option("compression", compression).text(path))


def _size_classes(headers: DataFrame) -> list[tuple[int, int]]:
    """(above, up to) payload bytes of the classes that have records, from the
    first, up to 4 times the mean, each 8 times as wide as the one before."""
    sums = headers.agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"), F.max("size").alias("most")).first()
    out, low, high = [], -1, max(HEADER_BYTES, 4 * (sums["bytes"] or 0) // (sums["rows"] or 1))
    while sums["rows"] and low < sums["most"]:
        out.append((low, min(high, sums["most"])))
        low, high = high, 8 * high
    if len(out) > 1:
        at = F.coalesce(*[F.when(F.col("size") <= top, F.lit(i)) for i, (_, top) in enumerate(out)])
        held = {r["at"] for r in headers.select(at.alias("at")).distinct().collect()}  # a number per class
        out = [c for i, c in enumerate(out) if i in held]
    return out


def _parse(batches: Iterator) -> Iterator:
    import gzip
    import hashlib

    names = ["page_id", "record_id", "record_type", "refers_to_record", "payload_digest", "payload_bytes", "url", "payload"]
    for batch in batches:
        for content in batch.column(0):
            whole = content.as_buffer().to_pybytes()
            if whole[:2] == b"\x1f\x8b":
                whole = gzip.decompress(whole)
            raw = memoryview(whole)
            at, out, held = 0, [[] for _ in names], 0
            while at < len(whole):
                stop = whole.index(b"\r\n\r\n", at)
                h = {}
                lines = whole[at:stop].split(b"\r\n")
                if lines[0] != b"WARC/1.1":
                    raise ValueError(f"no record at byte {at}")
                for line in lines[1:]:
                    k, _, v = line.partition(b": ")
                    h[k.lower()] = v.decode("utf-8")
                size = int(h[b"content-length"])
                body = stop + 4
                if whole[body + size:body + size + 4] != b"\r\n\r\n":
                    raise ValueError(f"record at byte {at} is cut")
                start = whole.index(b"\r\n\r\n", body, body + size) + 4
                full = h[b"warc-type"] == "response"
                payload = bytes(raw[start:body + size]) if full else None
                digest = h[b"warc-payload-digest"].removeprefix("sha1:")
                if full and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of record at byte {at} is not what its digest says")
                page = h.get(b"x-page-id")
                for col, v in zip(out, (int(page) if page is not None else None, h[b"warc-record-id"].strip("<>"), h[b"warc-type"],
                                        h[b"warc-refers-to"].strip("<>") if b"warc-refers-to" in h else None, digest,
                                        len(payload) if full else None, h.get(b"warc-target-uri"), payload)):
                    col.append(v)
                held += size
                at = body + size + 4
                if held > 4 << 20:
                    yield _batch(names, out)
                    out, held = [[] for _ in names], 0
            yield _batch(names, out)


def _batch(names, out):
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, record_id, record_type, refers_to_record,
    payload_digest, payload_bytes (NULL for revisits), url, payload."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
            .mapInArrow(_parse, "page_id long, record_id string, record_type string, refers_to_record string, "
                                "payload_digest string, payload_bytes long, url string, payload binary"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and refers_to (page_id) of revisits taken
    from the response they refer to."""
    records = records.drop("payload")
    originals = (records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"))
                 .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size")))
    revisits = records.filter("record_type = 'revisit'").join(originals, "refers_to_record", "left")
    plain = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).withColumn("size", F.col("payload_bytes"))
    return revisits.unionByName(plain).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back and report a row per page."""
    spark = pages.sparkSession
    path = path or stage_path(spark, "warc")
    write_archives(pages, path)
    records = materialize(read_archives(spark, path).drop("payload"), "warc-records")
    return resolve_revisits(records.withColumn("payload", F.lit(None).cast("binary")))
