import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from winnow.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, n long"


def page(page_id, html, url="http://a/b"):
    return (page_id, url, html, "p", "d", 1)


LONG = "<p>" + "long enough " * 20 + "é</p>"
PAGES = [page(5, LONG), page(3, LONG), page(3, LONG), page(9, LONG, None), page(1, "short"), page(2, "short"),
         page(4, None), page(7, ""), page(None, LONG), page(None, "alone " * 30), page(8, "x\r\nWARC/1.0\r\n\r\n" * 20),
         page(6, "big " * 300_000, "http://c/\r\nX: y")]


def written(spark, rows):
    return warc.write_warc(warc.as_records(spark.createDataFrame(rows, SCHEMA)))


def test_records_come_back(spark):
    path = written(spark, PAGES)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(PAGES)
    responses = sorted((r.record_id, bytes(r.payload).decode()) for r in got if r.record_type == "response")
    want = sorted((f"urn:page:{'none' if i is None else i}", h or "") for i, _, h, *_ in PAGES
                  if not (h == LONG and i != 3))
    assert responses == want
    revisits = {(r.record_id, r.refers_to, r.payload_length, r.payload_digest) for r in got if r.record_type == "revisit"}
    digest = "sha256:" + hashlib.sha256(LONG.encode()).hexdigest()
    assert revisits == {(f"urn:page:{i}", "urn:page:3", len(LONG.encode()), digest) for i in (5, 9, "none")}
    assert all(r.payload == b"" for r in got if r.record_type == "revisit")
    assert {r.target_uri for r in got} == {None, "http://a/b", "http://c/%0D%0AX: y"}


def test_predicates_are_tested_on_the_head(spark):
    path = written(spark, PAGES)
    heads = warc.read_warc(spark, path, types=["revisit"], payload=False)
    assert heads.count() == 3 and heads.where("payload is not null").count() == 0
    one = warc.read_warc(spark, path, headers={"WARC-Target-URI": ["http://c/%0D%0AX: y"]})
    assert [r.record_id for r in one.collect()] == ["urn:page:6"]
    assert warc.read_warc(spark, path, headers={"No-Such": ["x"]}).count() == 0


def test_spark_pushes_filters(spark):
    path = written(spark, PAGES)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = warc.read_warc(spark, path)
        assert rows.where("record_type = 'revisit'").count() == 3
        assert rows.where("record_id in ('urn:page:6', 'urn:page:8') and target_uri like 'http://a%'").count() == 1
        assert rows.where("target_uri is not null and payload_length > 1000").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("packed", ["none", "records", "file"])
def test_archives_of_others(spark, tmp_path, packed):
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (
        k, len(body), body) for k, body in enumerate([b"", b"\xff\x00\r\n\r\n", b"z" * 200_000])]
    if packed == "none":
        (tmp_path / "a.warc").write_bytes(b"".join(records))
    else:
        parts = records if packed == "records" else [b"".join(records)]
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {"urn:x:0": b"", "urn:x:1": b"\xff\x00\r\n\r\n", "urn:x:2": b"z" * 200_000}


def test_no_pages(spark):
    assert warc.read_warc(spark, written(spark, [])).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    path = written(spark, PAGES[:3])
    local = path.removeprefix("file://")
    with open(f"{local}/stray.warc.gz", "wb") as file:
        file.write(warc.encode_record([("WARC-Type", "response")], b"x"))
    assert warc.read_warc(spark, path).count() == 3


def test_query(spark, sf_dir):
    got = queries.LLM_QUERIES["op2_warc"](spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_digest"))
    assert got.select(*pages.columns).exceptAll(pages).count() == 0 and got.count() == pages.count()
