"""Archives and their index: round trips, revisits, hot keys, copies, small blocks and archives, task retries."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries as q
from corpusloom.llm import warc
from corpusloom.llm.workspace import Workspace

LONG = "<p>" + "é" * 200


def _pages():
    rows = [(i, f"http://www.Example.com/{i % 3}?q={i % 2}#f{i}", f"<html>{i % 40} {LONG}") for i in range(300)]
    rows += [(1000 + i, "https://hot.example.org:443/", f"short {i % 2}") for i in range(200)]
    rows += [(None, None, None), (2000, None, ""), (2001, "not a url", "x" * 99), (2002, "not a url", "x" * 99), (2003, "http://a.b/\r\nX: y", "x" * 100), (2004, "http://a.b", "x" * 100), (None, "http://n.n/", "x" * 100)]
    return rows + [(5, "http://same.row/", "twice " * 40), (5, "http://same.row/", "twice " * 40), (3000, "http://u@h.com:8080/a?b", "y" * 1_000_000)]


def _want(rows):
    """By page, url and payload, in plain Python; which of wholly equal rows responds is open."""
    first = {}
    for page_id, url, html in rows:
        body, own = (html or "").encode(), (page_id is None, page_id or 0, url or "")
        if len(body) >= 100:
            first[body] = min(first.get(body, own), own)
    out, seen = [], set()
    for page_id, url, html in rows:
        body, own = (html or "").encode(), (page_id is None, page_id or 0, url or "")
        revisit = body in first and (first[body] != own or (body, own) in seen)
        seen.add((body, own))
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body][1] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in _pages()], "page_id long, url string, html string, key string, digest string").repartition(4)


@pytest.mark.parametrize(("block", "size"), [(512, 64 << 20), (3, 2000)])
def test_pages_come_back(spark, pages, block, size):
    with Workspace(spark, "t") as work:
        archives = warc.write(pages, work.path("files"), work, archive_bytes=size, block_entries=block)
        assert archives.count() > (20 if block == 3 else 0) and archives.agg(F.sum("records")).first()[0] == len(_pages())
        found = warc.lookup(pages.select(warc.url_key(F.col("url")).alias("key")), work.path("files"), archives)
        rows = found.collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == _want(_pages())
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in rows if r.record_type == "response")
        hot = spark.createDataFrame([("org,example,hot)/",), ("org,example,none)/",), ("",)], "key string")
        assert sorted(r.page_id or 0 for r in warc.lookup(hot, work.path("files"), archives).collect()) == [0, 1000, *range(1001, 1200), 2000]
        # a plain reader finds the same records one after the other
        name = archives.orderBy("name").first()["name"]
        data = gzip.decompress(open(f"{work.path('files').removeprefix('file://')}/{name}.warc.gz", "rb").read())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_query_equals_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, q.op13_warc(spark, sf_dir).collect()), key=str) == _want(rows)


def test_an_empty_table_gives_no_rows(spark, pages):
    with Workspace(spark, "t") as work:
        archives = warc.write(pages.limit(0), work.path("files"), work)
        assert warc.lookup(spark.createDataFrame([("a",)], "key string"), work.path("files"), archives).count() == 0


def test_keys(spark):
    urls = ["http://www.Example.COM:80/a/B?c#d", "https://u:p@x.y:8080", "plain", None, "http://h/?q", "ftp://a.b.c/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url"))).collect()]
    assert got == ["com,example,www)/a/B?c", "y:8080,x)/", "plain", "", "h)/?q", "c,b,a)/"]


def test_records_round_trip():
    digest = hashlib.sha256(b"abc").hexdigest()
    headers, size, payload = warc.parse(warc.record(7, "http://a/\r\nb", b"abc", digest, None))
    assert (headers["X-Page-ID"], headers["WARC-Type"], size, payload) == ("7", "response", 3, b"abc")
    headers, size, payload = warc.parse(warc.record(None, None, b"abc", digest, (7, "http://a/")))
    assert (headers["WARC-Type"], headers["X-Refers-To-Page-ID"], "X-Page-ID" in headers, size, payload) == ("revisit", "7", False, 3, b"")
    with pytest.raises(ValueError, match="whole"):
        warc.parse(warc.record(7, "u", b"abc", digest, None)[:-2])
