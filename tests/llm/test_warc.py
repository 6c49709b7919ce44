from __future__ import annotations

import base64
import hashlib
import random

from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, n int, payload string"


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    row = lambda: (rng.choice("abc"), rng.choice("12"), rng.choice([None, 1, 2, 3]), None, "", 0, "", None, "r", rng.randint(0, 50), 0)
    for k in range(8):
        runs = [sorted((row() for _ in range(rng.randint(0, 9))), key=warc.sort_key) for _ in range(k)]
        merged = list(warc.merge(runs))
        assert [warc.sort_key(r) for r in merged] == sorted(warc.sort_key(r) for run in runs for r in run)


def test_url_key():
    assert warc.url_key("HTTPS://www.Example.org:443/a?b=2&a=1#top") == "org,example)/a?a=1&b=2"
    assert warc.url_key("http://example.org") == "org,example)/"
    assert warc.url_key(None) == ""


def expected(rows):
    out = []
    for p, _, html in rows:
        payload = (html or "").encode()
        same = [q for q, _, h in rows if (h or "") == (html or "") and q is not None]
        top = max(same, default=None)
        first = top is None or p == top
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((p, len(payload), digest, "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://b.org/x", "one"), (2, "http://a.org/", "two\r\n\r\nWARC/1.1\r\nß"), (3, "http://a.org/", "one"), (4, None, None)]
    rows += [(5, "no scheme", ""), (6, "http://a.org/\r\nX: y", "x" * 200_000), (3, "http://a.org/", "one"), (None, "http://c.org/", "one")]
    rows += [(100 + i, f"http://h{i % 5}.org/p{i}", f"text {i % 3}") for i in range(40)]
    df = spark.createDataFrame([(*r, "a", 1, "p") for r in rows], SCHEMA).repartition(3)
    folder = f"{tmp_path}/w"
    out = warc.archive_pages(df, folder, archive_bytes=2_000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=repr)
    assert got == expected(rows)
    order = [(r.url_key, r.captured) for r in out.orderBy("position").collect()]
    assert order == sorted(order)
    assert out.select("archive").distinct().count() > 3
    assert {r.url for r in out.collect()} >= {"http://a.org/", None}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
