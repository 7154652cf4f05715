import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quern.llm import warc
from quern.llm.common import shared_dir

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "x" * 200_000), (6, "http://a\r\n/6", "<p>é</p>"), (None, "http://a/7", "<p>é</p>"), (6, "http://a/6", "<p>é</p>")]


@pytest.fixture
def archived(spark):
    def go(rows, **options):
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, **options)
        return path

    return go


def test_round_trip(spark, archived):
    path = archived(PAGES)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.parsed(warc.read_archive(spark, path)).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    want = set()
    for i, _, h in PAGES:
        last = max(j for j, _, g in PAGES if (g or "") == (h or "") and j is not None)
        want.add((i, "response" if i == last else "revisit", None if i == last else last, len((h or "").encode()), digest(h)))
    assert got == want
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_records_are_exact_and_verified(spark, archived):
    path = archived(PAGES[:2])
    records = warc.record_bytes(warc.read_archive(spark, path)).collect()
    for r in records:
        raw = bytes(r["record"])
        head, rest = raw.split(b"\r\n\r\n", 1)
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert raw.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        assert rest.split(b"\r\n\r\n", 1)[1][: -4] == ("<p>é</p>".encode() if r["type"] == "response" else b"")
    bad = f"{path}-bad"
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, bad).collect()


def test_small_payloads_and_no_pages(spark, archived):
    got = warc.parsed(warc.read_archive(spark, archived(PAGES, min_revisit=1000)))
    assert got.filter("record_type = 'revisit'").count() == 0
    assert warc.parsed(warc.read_archive(spark, archived([]))).count() == 0
