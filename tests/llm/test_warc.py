import base64
import hashlib
import random

import pytest

from relayout.llm import queries, warc

from .conftest import SF, collected


def brute(rows, least):
    first = {}
    for page_id, payload in sorted(rows, key=lambda row: (row[0] is None, row[0] or 0)):
        first.setdefault(payload, page_id)
    out = []
    for page_id, payload in rows:
        lead = first[payload]
        revisit = len(payload) >= least and lead != page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=repr)


PICK = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_given_table(spark, duck):
    rows = [(i, (html or "").encode()) for i, html in duck.execute("SELECT page_id, html FROM pages").fetchall()]
    got = collected(queries.QUERIES["op8_warc"](spark, SF).select(PICK))
    assert sorted(got, key=repr) == brute(rows, 0)


@pytest.mark.parametrize("least", [0, 3])
def test_odd_rows(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "RUN_ROWS", 3)
    long = "é<p>" * 50_000
    rows = [
        (1, "http://A.example/x", "same"), (2, None, "same"), (3, "http://a.example/x", None), (4, "", ""),
        (5, "bad url\r\nWARC-Type: fake", long), (6, "https://www.b.example:443/q?a#f", long), (7, "u", "ab"), (8, "u", "ab"),
        (1, "http://A.example/x", "same"), (None, "n", "same"), (None, "n", "none"), (9, "\r\n\r\n", "\r\n\r\nWARC/1.1"),
    ]
    schema = "page_id long, url string, html string, payload string, sha string, key string, run string"
    pages = spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], schema)
    found = warc.round_trip(pages, least)
    want = brute([(row[0], (row[2] or "").encode()) for row in rows], least)
    assert sorted(collected(found.select(PICK)), key=repr) == want
    kept = {(r.page_id, bytes(r.payload)) for r in found.collect() if r.record_type == "response"}
    assert (5, long.encode()) in kept and (9, b"\r\n\r\nWARC/1.1") in kept


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_index_is_ordered(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    seed = random.Random(1)
    rows = [(i, f"http://{seed.choice('abc')}.example/{seed.randint(0, 5)}", str(i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    runs = warc.write_archives(pages, warc.archive_folder(spark))
    index = [(r.key, r.time, r.page_id) for r in warc.merge_runs(runs, 300).collect()]
    assert index == sorted(index) and len(index) == 300
    for run in {r.run for r in runs.collect()}:
        mine = [(r.key, r.time) for r in runs.where(runs.run == run).collect()]
        assert mine == sorted(mine) and len(mine) <= 7


def test_loser_tree():
    seed = random.Random(2)
    for _ in range(200):
        runs = [sorted((seed.randint(0, 20),) for _ in range(seed.randint(0, 8))) for _ in range(seed.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/A?b#c") == "com,example)/a?b"
    assert warc.url_key("http://user@x.y") == "y,x)/" and warc.url_key(None) == ""
