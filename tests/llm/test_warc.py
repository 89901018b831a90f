import base64
import gzip
import hashlib
from pathlib import Path

from sparkloom.llm import warc as wc
from sparkloom.llm.queries import ORACLES, QUERIES

from .oracle import same

SCHEMA = "page_id long, url string, html string, digest string"


def test_query_against_sql(spark):
    assert same(spark, "/root/testdata/sf0.01", QUERIES["op6_warc"], ORACLES["op6_warc"]) == 250


def test_round_trip(spark, tmp_path):
    big = 2**60 + 1
    rows = [(1, "http://a/", "same é", "x"), (big, "http://b/", "same é", "x"), (5, None, "same é", None), (None, "http://n/\r\nX: y", "same é", None), (7, "u", None, None), (8, "u", "", None), (9, "u", "other\r\n\r\nWARC/1.1\r\n", None), (9, "u", "other\r\n\r\nWARC/1.1\r\n", None), (10, "u", "z" * 300000, None), (None, None, "lone", None), (None, None, "lone", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    root = f"file://{tmp_path}/w"
    index = wc.write(df, root, archive_bytes=200)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 1
    got = wc.resolved(wc.read(index, root)).collect()
    assert sorted((str(r.page_id), r.payload) for r in got) == sorted((str(i), h or "") for i, _, h, _ in rows)
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", 7, "revisit", big), (str(big), 7, "response", None), ("5", 7, "revisit", big), ("None", 7, "revisit", big), ("7", 0, "revisit", 8), ("8", 0, "response", None), ("9", 19, "response", None), ("9", 19, "response", None), ("10", 300000, "response", None), ("None", 4, "response", None), ("None", 4, "response", None)])
    for r in got:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload.encode()).digest()).decode()
    some = index.where("page_id = 10 or page_id = 1")
    assert {r.page_id for r in wc.read(some, root).collect()} == {1, 10}
    # the files are plain multi-member gzip of WARC records
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").iterdir())
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    larger = wc.write(df, root, min_bytes=8)
    assert {r.page_id for r in larger.where("record_type = 'revisit'").collect()} == set()
    assert wc.read(wc.write(df.limit(0), root), root).count() == 0


def test_ranges_coalesce():
    assert wc.ranges([(0, 10), (10, 5), (20, 5), (200, 5)], 5, 100) == [(0, 25, 3), (200, 205, 1)]
    assert wc.ranges([(0, 10), (10, 10), (20, 10)], 0, 20) == [(0, 20, 2), (20, 30, 1)]
    assert wc.ranges([], 5, 100) == []
