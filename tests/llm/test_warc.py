import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from attestra.llm import warc

LONG, OTHER = "x" * 1_500, "é" * 600
ROWS = [(1, "http://A.Example.com/x?q", LONG), (2, "https://a.example.com/x?q", LONG), (3, None, LONG), (4, "b", "short"), (5, "b", "short"), (6, "", None), (None, "c", "nid"), (7, "d\r\ne", OTHER), (8, "d", OTHER), (8, "d", OTHER)]


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    root, shards = warc.archive(df)
    records = warc.read_captures(df.select(warc.surt(F.col("url")).alias("key")), shards, root)
    return records, warc.resolved(records)


def test_records_and_revisits(spark):
    records, out = read_back(spark, ROWS)
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out.collect()], key=str)
    want = [(1, 1500, "revisit", 3), (2, 1500, "revisit", 3), (3, 1500, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (None, 3, "response", None)]
    want += [(7, 1200, "revisit", 8), (8, 1200, "response", None), (8, 1200, "response", None)]
    assert got == sorted(want, key=str)
    texts = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert texts[3] == LONG and texts[6] == "" and texts[8] == OTHER


def test_repeated_page_with_other_payloads(spark):
    """A page_id that two payloads share: revisits keep the length and digest of their own."""
    records, out = read_back(spark, [(9, "a", LONG), (9, "b", OTHER), (1, "c", LONG), (2, "d", OTHER)])
    got = {(r.page_id, r.record_type): (r.payload_bytes, r.payload_digest, r.refers_to) for r in out.where("page_id < 9").collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {(1, "revisit"): (1500, sha(LONG), 9), (2, "revisit"): (1200, sha(OTHER), 9)}
    assert sorted(r.payload_bytes for r in out.where("page_id = 9 AND record_type = 'response'").collect()) == [1200, 1500]


def test_empty_table(spark):
    records, out = read_back(spark, [])
    assert out.count() == 0


def test_many_captures_of_one_key_cross_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{i}.example/{i}", f"body {i}") for i in range(400)]
    records, out = read_back(spark, rows)
    assert sorted(r.page_id for r in out.collect()) == list(range(400))


def test_reversed_host(spark):
    df = spark.createDataFrame([("http://WWW.B.example/P?q#f",), (None,), ("host",)], "url string")
    assert [r[0] for r in df.select(warc.surt(F.col("url"))).collect()] == ["example,b,www)/P?q#f", ")", "host)"]


def test_damaged_payload_is_refused():
    member = warc._record(1, "u", "x", b"payload", None, "00")
    with pytest.raises(ValueError):
        warc.parse_record(member)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\n")
