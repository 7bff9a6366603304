import base64
import hashlib
import random

import pytest

from millrace.llm import warc as W
from millrace.llm.common import Scratch


def brute(rows, least):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    count = {}
    for _, _, html in rows:
        count[(html or "").encode()] = count.get((html or "").encode(), 0) + 1
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and count[data] > 1 and data in first and first[data] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(0)
    texts = ["", None, "ü\r\n\r\nWARC/1.1\r\nContent-Length: 3", "a" * 40_000, "\n", "x\r\n\r\n", "same"] + [f"<p>{k}</p>" for k in range(20)]
    rows = [(i, f"http://h{rng.randrange(5)}.Example.com/{rng.randrange(30)}?a=b#c", rng.choice(texts)) for i in range(300)]
    return rows + [(1000, None, "same"), (1001, "no scheme\r\nX: y", "z"), (1002, "http://a/x\ny", "q"), (1003, "http://a/x!z", "q2"), (1004, "http://a/x", "long " * 300_000), (None, "http://a/", "same"), (None, "http://a/", "only"), (5, rows[5][1], rows[5][2])]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    out = W.archive(df, least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows, least)
    ranked = sorted(out, key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in ranked] == list(range(len(rows)))
    keys = [(r.url_key.encode(), r.ts, r.page_id is None, r.page_id or 0) for r in ranked]
    assert keys == sorted(keys)


def test_files_are_warc(spark):
    path = f"{Scratch(spark, 'w').path}/archives"
    W.write_warc(spark.createDataFrame(corpus(), "page_id long, url string, html string"), path)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    seen = 0
    for f in rows:
        for offset, length, head, block in W.records(bytes(f.content)):
            assert bytes(f.content)[offset : offset + 8] == b"WARC/1.1" and int(head["Content-Length"]) == len(block) and bytes(f.content)[offset + length - 4 : offset + length] == b"\r\n\r\n"
            seen += 1
    assert seen == len(corpus())


def test_files_are_bounded_by_bytes(spark):
    rows = spark.range(60).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "repeat(concat('page ', id % 50, ' '), 130000) AS html").coalesce(1)
    out = W.archive(rows.unionByName(spark.range(60, 3000).selectExpr("id AS page_id", "'http://b/' AS url", "'small' AS html")), 0)
    path = f"{Scratch(spark, 'w').path}/archives"
    W.write_warc(rows, path, file_bytes=16 << 20)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()
    assert len(files) >= 3 and max(f[0] for f in files) < 17 << 20
    assert out.count() == 3000 and out.where("record_type = 'revisit'").count() == 10 + 2939


def test_a_payload_of_most_pages(spark, monkeypatch):
    monkeypatch.setattr(W, "SALT_ROWS", 7)
    monkeypatch.setattr(W, "WORDS", 2)
    rows = [(i, f"http://a/{i}", "common" if i % 3 else f"own {i // 6}") for i in range(600)]
    out = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), 0).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows, 0)


def test_loser_merge():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(W.loser_merge([[(x,) for x in r] for r in runs])) == sorted((x,) for r in runs for x in r)


def test_more_ranges_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 20)
    rows = corpus()
    out = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), 0).collect()
    ranked = sorted(out, key=lambda r: r.capture_rank)
    keys = [(r.url_key.encode(), r.ts, r.page_id is None, r.page_id or 0) for r in ranked]
    assert [r.capture_rank for r in ranked] == list(range(len(rows))) and keys == sorted(keys)


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
