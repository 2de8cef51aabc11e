import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from uttermark.llm.warc import page_records, payload_digest, read_warc, urn_page, write_warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a.example/x y\r\nEvil: 1", "<p>é</p>\r\n\r\nWARC/1.1\r\n"),
    (2, None, "same"), (5, "http://b.example/", "same"), (3, "http://c.example/", "same"),
    (7, "u", None), (8, "v", ""), (9, "w", "x" * 3_000_000), (None, "n", "same"), (None, None, "alone"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("first", F.lit(1)).repartition(3)
    write_warc(page_records(pages), path)
    return path


def test_round_trip(spark, archive):
    rows = read_warc(spark, archive).select("*", urn_page(F.col("record_id")).alias("page_id")).collect()
    assert len(rows) == len(ROWS)
    by_payload = {}
    for page, _, html in ROWS:
        by_payload.setdefault(html or "", []).append(page)
    for r in rows:
        html = next(h or "" for p, u, h in ROWS if p == r.page_id and (p is not None or h == "alone" or r.record_type == "revisit"))
        if r.record_type == "revisit":
            assert r.page_id in (2, 3, 7, None) and r.payload is not None and len(r.payload) == 0
            assert r.refers_to in ("<urn:x-page:5>", "<urn:x-page:8>")
        else:
            assert r.payload == html.encode() and r.payload_valid
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == payload_digest(html.encode())
    first = next(r for r in rows if r.page_id == 1)
    assert first.target_uri == "http://a.example/x%20y%0D%0AEvil:%201"
    assert payload_digest(b"a") == "sha1:" + base64.b32encode(hashlib.sha1(b"a").digest()).decode()


def test_filters_reach_the_parser_and_payloads_can_stay_unread(spark, archive):
    some = read_warc(spark, archive, payload="none").filter("record_type = 'revisit'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "record_type" not in plan.split("BatchScan")[0]
    assert some.count() == 4 and some.filter("payload IS NOT NULL").count() == 0
    assert read_warc(spark, archive).filter(F.col("target_uri").startswith("http://b")).count() == 1
    assert read_warc(spark, archive, payload="response", bundle_bytes=1).filter("payload IS NULL").count() == 4


def test_small_payloads_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert page_records(pages, min_bytes=5).filter("record_type = 'revisit'").count() == 0
    path = str(tmp_path / "none")
    write_warc(page_records(pages.limit(0)), path)
    assert read_warc(spark, path).count() == 0
