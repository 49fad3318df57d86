"""Crawls against a plain walk, links against urljoin, and literal pages as Markdown."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar as s
from corpusloom.functions.urls import LEFT_OUT
from corpusloom.operators import crawl
from corpusloom.operators import markdown as md
from corpusloom.plans import catalog
from corpusloom.sources.tables import stored

LONG = "Words that say something about the matter at hand, and go on to say more of it, so that they are more than twenty in all here."


def _links(url, html):
    for m in re.finditer(crawl.HREF, html or ""):
        href = (m[1] or m[2] or m[3] or "").strip(" ").replace("&amp;", "&").split("#")[0]
        if href and (re.match("(?i)https?://[^/?#]", href) or not re.match("[A-Za-z][A-Za-z0-9+.-]*:", href)):
            yield urljoin(url, href)


def _walk(pages, seeds, texts, most, depth, filtering):
    html = {}
    for url, h in pages:
        url = url.split("#")[0]
        if url not in html or (len(h or ""), h or "") > (len(html[url] or ""), html[url] or ""):
            html[url] = h
    host = lambda u: re.sub("^www\\.", "", urlsplit(u).netloc.lower())
    level, visited, filtered, levels = {u.split("#")[0] for u in seeds}, {}, 0, 0
    while levels < depth and len(visited) < most:
        chosen = sorted(level - set(visited))[: most - len(visited)]
        if not chosen:
            break
        levels += 1
        visited |= {u: (levels, u in html) for u in chosen}
        if len(visited) >= most:
            break
        level = set()
        for u in chosen:
            for to in _links(u, html.get(u)) if texts.get(u) else ():
                if host(to) == host(u) and to not in visited:
                    if filtering and any(re.search(p, to) for p in LEFT_OUT):
                        filtered += 1
                    else:
                        level.add(to)
    return visited, filtered, levels


WEB = [
    ("http://a.com/", '<a href="/b">b</a><a href=\'c/d?x=1&amp;y=2\'>c</a><a href=e#f>e</a><a href="http://www.a.com/g">g</a><a href="//h.com/x">h</a><a href="mailto:x@y">m</a><a href="#top">t</a><a href="/b/commits/1">no</a>'),
    ("http://a.com/b", 'text <a href="../../c/./d/../k">k</a><a href="?q=2">q</a><a href="">self</a><a href="/tags?x">no</a><a href="/b/commits/1">no</a>'),
    ("http://a.com/b#part", "short"), ("http://a.com/c/d?x=1&y=2", '<p>leaf<a class="x" href="f">f</a></p>'), ("http://a.com/e", "<a href='/'>back</a>"), ("http://a.com/c/f", None), ("http://h.com/x", "h"), (None, "none"), ("http://www.a.com/g", ""),
]


@pytest.mark.parametrize(("most", "depth", "filtering"), [(100, 3, True), (100, 3, False), (3, 9, True), (4, 2, True), (100, 1, True), (0, 3, True)])
def test_crawls_equal_a_walk(spark, most, depth, filtering):
    pages = spark.createDataFrame(WEB, "url string, html string").repartition(3)
    seeds = ["http://a.com/#x", "http://a.com/", "http://nowhere.com/"]
    visited, counters = crawl.crawl(pages, spark.createDataFrame([(u,) for u in [*seeds, None]], "url string"), stored, max_pages=most, max_depth=depth, filtering=filtering)
    texts = {r["u"]: r["t"] for r in pages.where("url IS NOT NULL").groupBy(s.normalize_url(F.col("url")).alias("u")).agg(F.max_by("html", F.struct(F.length("html"), "html")).alias("h")).select("u", s.html_text(F.col("h")).alias("t")).collect()}
    want, filtered, levels = _walk([p for p in WEB if p[0]], seeds, texts, most, depth, filtering)
    assert {r["url"]: (r["depth"], r["found"]) for r in visited.collect()} == want
    kept = [u for u in want if texts.get(u)]
    assert counters == {"urls_crawled": len(want), "urls_filtered": filtered, "levels": levels, "urls_stored": len(kept), "chunks_stored": len(kept)}


def test_query_equals_a_walk(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    texts = {r["u"]: r["t"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(s.normalize_url(F.col("url")).alias("u"), s.html_text(F.col("html")).alias("t")).collect()}
    want, _, _ = _walk([p[1:] for p in pages if p[1]], [p[1] for p in pages if p[0] % 50 == 0], texts, len(pages), 2, True)
    assert {r["url"]: (r["depth"], r["found"]) for r in catalog.queries()["budgeted_crawl"](spark, sf_dir).collect()} == want


def test_addresses_resolve_as_urljoin(spark):
    bases = ["http://a.com", "http://a.com/", "http://a.com/b/c", "https://u.org:8/b/c/?q=1#x", "http://a.com/b/c?q=/z"]
    hrefs = ["x", "/x", "./x", "../x", "../../../x", "x/../y/.", "?z=1", "//o.com/p", "https://k.com", "x?y=/../z", "..", "."]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string").select("base", "href", crawl.resolved(F.col("base"), F.col("href")).alias("to")).collect()
    assert {(r["base"], r["href"]): r["to"] for r in rows} == {(b, h): urljoin(b, h).split("#")[0] for b in bases for h in hrefs}


def test_first_rows_cut_at_the_budget(spark):
    rows = spark.range(1000).select(F.format_string("%04d", "id").alias("k")).repartition(7)
    for n in (0, 1, 333, 1000, 2000):
        assert sorted(r["k"] for r in crawl.first_rows(rows, "k", n, stored).collect()) == [f"{i:04d}" for i in range(min(n, 1000))]
    assert crawl.first_rows(rows.limit(0), "k", 5, stored).count() == 0


PAGE = f"""<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href="/a">A {LONG}</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>The  title</h1><p>{LONG} <b>bold</b> and <a href="../x?q=1">a link</a>.<br>New <em>line</em><p>Second {LONG}
<ul><li>one <i>it</i></li><li>two<ol><li>inner {LONG}</li></ol></li></ul><pre><code>x = 1
  y {LONG}</code></pre><blockquote>{LONG}</blockquote><table><tr><th>h<th>i</tr><tr><td>{LONG}</td></tr></table><p>too short</p></article>
<div><a href="u">{LONG}</a></div><div><div><p>Nested {LONG}</p></div></div><script>var t = "</p>";</script><footer>gone</footer></body></html>"""


def test_markdown():
    raw, fit, links = md.convert(PAGE, "http://h.com/d/e.html")
    body = [
        "# The title", f"{LONG} **bold** and [a link](http://h.com/x?q=1).\nNew *line*", f"Second {LONG}", f"* one *it*\n* two\n  1. inner {LONG}", f"```\nx = 1\n  y {LONG}\n```", f"> {LONG}",
        f"| h | i |\n| --- | --- |\n| {LONG} |  |",
    ]
    assert raw == "\n\n".join(["Buy now", *body, "too short", f"[{LONG}](http://h.com/d/u)", f"Nested {LONG}"])
    # the short parts, the advertisement and the part that is all link go
    assert fit == "\n\n".join([*body, f"Nested {LONG}"])
    assert links == ["http://h.com/x?q=1", "http://h.com/d/u"]
    assert md.convert("<p>few words</p>")[1] == "" and md.convert(f"<p>{LONG}</p>")[1] == LONG and md.convert(f"<p>{LONG}</p>", threshold=2.0)[1] == ""


def test_odd_pages(spark):
    assert md.convert("<div>" * 3000 + "deep" + "</div>" * 3000)[0] == "deep"
    assert md.convert("<p>a<p>b</div></b><li>c<li>d")[0].split() == ["a", "b", "c", "d"]
    for page in ("", "<", "<a href=", "<!--", "text &amp; <b>", "</p>", "<a href='http://[x'>y</a>"):
        md.convert(page, "http://h.com/")
    rows = spark.createDataFrame([("http://a.b/", f"<p>{LONG}</p><p>x</p>", 1), (None, None, 2), ("u", "<p>x</p>", 3)], "url string, html string, raw int").withColumnRenamed("raw", "links_before")
    got = {r["links_before"]: (r["content"], r["fit"]) for r in md.markdown(rows).collect()}
    assert got == {1: (LONG, LONG), 2: ("", ""), 3: ("x", "")}
