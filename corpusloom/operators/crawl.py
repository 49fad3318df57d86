"""A crawl over a table of pages: levels of links within a host, cut to a budget of pages, and what is stored of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions.urls import left_out

_SCHEME, _HOST = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def hrefs(html: Column) -> Column:
    """Targets of a page's links as they are written, in double, single or no quotes; &amp; is read as &."""
    found = [F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3)]
    both = lambda a, b: F.concat(a, b)
    one = F.zip_with(F.zip_with(found[0], found[1], both), found[2], both)
    return F.transform(one, lambda x: F.btrim(F.replace(x, F.lit("&amp;"), F.lit("&"))))


def _without_dots(path: Column) -> Column:
    """A path whose . and .. parts are resolved."""
    parts = F.split(path, "/")
    # the first part is empty, as a path begins with a slash; .. does not go beyond it
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    ends = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def resolved(base: Column, href: Column) -> Column:
    """The address that a link on page `base` leads to, without its fragment; null for other schemes than http and https and for a link within the page."""
    base = s.normalize_url(base)
    link = s.normalize_url(href)
    scheme, host = F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":")), F.regexp_extract(base, _HOST, 1)
    root = F.concat(scheme, F.lit("//"), host)
    path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"\?[\s\S]*$", "")
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    query = F.regexp_extract(link, r"(\?[\s\S]*)$", 1)
    bare = F.regexp_replace(link, r"\?[\s\S]*$", "")
    inside = F.when(bare == "", path).when(bare.startswith("/"), _without_dots(bare)).otherwise(_without_dots(F.concat(folder, bare)))
    return (
        F.when(link == "", None)
        .when(link.rlike("(?i)^https?://[^/?#]"), link)
        .when(link.rlike(_SCHEME), None)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(base.rlike("(?i)^https?://[^/?#]"), F.concat(root, inside, query))
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): every link of pages (url, html), resolved, between addresses without fragments; `internal` where the host stays the same."""
    found = pages.select(s.normalize_url(F.col("url")).alias("src"), F.explode(hrefs(F.col("html"))).alias("href"))
    out = found.select("src", resolved(F.col("src"), F.col("href")).alias("dst")).where("dst IS NOT NULL")
    return out.withColumn("internal", F.coalesce(s.domain(F.col("src")) == s.domain(F.col("dst")), F.lit(False)))


def first_rows(rows: DataFrame, key: str, n: int, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The n rows of the smallest keys. Rows are dealt by ranges of the key and counted by range; whole ranges are taken up to the one
    that fills n, so no task sees more than its own range."""
    dealt = store(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    before, left = [], n
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # a row a task
        before.append((r["_range"], max(0, left)))
        left -= r["count"]
        if left <= 0:
            break
    if not before:
        return dealt.drop("_range")
    last, room = before[-1]
    edge = dealt.where(F.col("_range") == last).orderBy(key).limit(room)
    return dealt.where(F.col("_range") < last).unionByName(edge).drop("_range")


def crawl(pages: DataFrame, seeds: DataFrame, store: Callable[[DataFrame, str], DataFrame], *, max_pages: int = 15, max_depth: int = 2, filtering: bool = True, text: Callable[[Column], Column] = s.html_text, chunk_size: int = 4000) -> tuple[DataFrame, dict[str, int]]:
    """(visited, counters) of a crawl over pages (url, html) from seeds (url).

    visited: (url, depth, found, content). A level is the addresses that the one before led to, within their hosts, not yet
    visited and, if `filtering`, not among those that a crawl leaves out; seeds are not filtered. Of a level the first addresses by
    name are taken, as far as the budget goes. An address without a page counts as crawled and is not found. Of pages with
    one address the longest counts. Counters: urls_crawled, urls_stored and chunks_stored (pages with some text), urls_filtered
    (links left out, each time they are met on a page with text), levels.
    """
    own = pages.where("url IS NOT NULL").groupBy(s.normalize_url(F.col("url")).alias("url")).agg(F.max_by("html", F.struct(F.length("html"), "html")).alias("html"))
    own = store(own.select("url", "html", text(F.col("html")).alias("content")), "pages")
    level = seeds.where("url IS NOT NULL").select(s.normalize_url(F.col("url")).alias("url")).distinct()
    visited, done = None, {"urls_crawled": 0, "urls_filtered": 0, "levels": 0}
    while done["levels"] < max_depth and done["urls_crawled"] < max_pages:
        fresh = level if visited is None else level.join(visited.select("url"), "url", "left_anti")
        chosen = first_rows(fresh, "url", max_pages - done["urls_crawled"], store)
        got = store(chosen.join(own.withColumn("found", F.lit(True)), "url", "left").select("url", F.lit(done["levels"] + 1).alias("depth"), F.coalesce("found", F.lit(False)).alias("found"), "content", "html"), "level")
        n = got.count()
        if not n:
            break
        visited = got.drop("html") if visited is None else visited.unionByName(got.drop("html"))
        done["urls_crawled"] += n
        done["levels"] += 1
        if done["urls_crawled"] >= max_pages or done["levels"] >= max_depth:
            # links of the last level lead nowhere, but what would be left out of them is counted while budget remains
            if done["urls_crawled"] >= max_pages:
                break
        out = links(got.where("content <> ''")).where("internal").join(visited.select(F.col("url").alias("dst")), "dst", "left_anti")
        barred = left_out(F.col("dst")) if filtering else F.lit(False)
        done["urls_filtered"] += out.where(barred).count()
        level = store(out.where(~barred).select(F.col("dst").alias("url")).distinct(), "frontier")
    if visited is None:
        visited = own.limit(0).select("url", F.lit(0).alias("depth"), F.lit(False).alias("found"), "content")
    stored_pages = visited.where("content <> ''").agg(F.count(F.lit(1)).alias("urls"), F.coalesce(F.sum(F.size(s.chunks(F.col("content"), chunk_size))), F.lit(0)).alias("chunks")).first()
    return visited, done | {"urls_stored": stored_pages["urls"], "chunks_stored": stored_pages["chunks"]}
