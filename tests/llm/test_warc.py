"""WARC: round trip of the archives and the revisit rule."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grainline.llm import warc as A

SCHEMA = "page_id long, url string, html string, digest string, size int, block string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "b") for i, u, h in rows], SCHEMA)


BIG = "é" * 700 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [(1, "http://a/", BIG), (5, "http://b/ x\r\ny", BIG), (5, "http://b/ x\r\ny", BIG), (3, None, BIG), (None, "http://c/", BIG),
        (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "u", None), (12, "u", ""),
        (None, "u", "z" * 2000), (None, "v", "z" * 2000), (13, "u", "\n" * 1500), (14, "u", "long " * 400000)]


def expected(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, A.BROADCAST_ORIGINALS])
def test_report(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_ORIGINALS", limit)
    got = A.archive_report(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    A.write_archives(pages(spark, ROWS).repartition(3), path, archive_bytes=3000, compression=compression)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3
    records = A.read_archives(spark, path)
    full = records.filter("record_type = 'response'").select("page_id", F.decode("payload", "utf-8").alias("p")).collect()
    payloads = {(i, h or "") for i, _, h in ROWS}
    assert {(r.page_id, r.p) for r in full} <= payloads
    assert {r.p for r in full} == {h for _, h in payloads}
    assert records.filter("record_type = 'revisit' and (payload is not null or refers_to_record is null)").count() == 0
    urls = {r.url for r in records.filter("page_id = 5").collect()}
    assert urls == {"http://b/%20x%0D%0Ay".replace("%0D%0A", "%20%20")}
    if compression == "none":
        head = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
        assert head.count(b"WARC-Type: ") == len(ROWS) and b"WARC-Profile: http" in head


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Large pages side by side: a file holds little or one record."""
    rows = [(i, "http://u/", f"{i} " + "p" * (200 + i % 50)) for i in range(600)] + [(1000 + i, "http://u/", f"{i} " + "q" * (40_000 * (1 + i % 4))) for i in range(60)]
    path = str(tmp_path / "w")
    A.write_archives(pages(spark, rows).coalesce(1), path, archive_bytes=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 162_000 and sum(x > 100_000 for x in sizes) == 30  # of one record each
    assert sorted(r.page_id for r in A.read_archives(spark, path).collect()) == sorted(i for i, _, _ in rows)


def test_damaged_archive(spark, tmp_path):
    (tmp_path / "part-1").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="is cut"):
        A.read_archives(spark, str(tmp_path)).collect()


def test_empty(spark):
    assert A.archive_report(pages(spark, ROWS).limit(0)).collect() == []
