"""Registered queries of search results, tables by URL, URL checks, Markdown, and code-graph validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import text as x
from ..functions import urls as u
from ..operators import checks as c
from ..operators import code as k
from ..operators import retrieval as r
from ..sources import tables as t
from .catalog import _TOP, _multi, _query

_NOW = 1_706_659_200

# search results ---------------------------------------------------------------------------------

_PIECES = "SELECT doc_id, source || '/' || (doc_id % 7) AS url, lang, doc_id AS chunk_number, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 0 ELSE 1700000000 + doc_id * 3600 END AS crawled_at, text AS content FROM documents"


def _pieces(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    crawled = F.when(doc % 5 == 0, None).when(doc % 5 == 1, 0).otherwise(1_700_000_000 + doc * 3600)
    return t.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), (doc % 7).cast("string")).alias("url"), "lang", doc.alias("chunk_number"), crawled.alias("crawled_at"), F.col("text").alias("content"))


def _results(spark, d, k: int) -> DataFrame:
    near = _multi(spark, d).where(F.col("rank") <= k)
    return near.select("query_id", F.col("vec_id").alias("doc_id"), "similarity", "rank").join(_pieces(spark, d), "doc_id")


_FIRST = f"SELECT * FROM ({_TOP} WHERE q.vec_id % 50 = 0) v JOIN ({_PIECES}) p ON v.vec_id = p.doc_id WHERE rank <= 10"


@_query(f"""SELECT query_id, url, arg_min(lang, rank) AS lang, round(max(s), 6) AS similarity, max(CASE WHEN crawled_at > 0 THEN crawled_at END) AS crawled_at, count(*) AS n_chunks,
sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_number, rank)) AS content_sha256 FROM ({_FIRST}) GROUP BY query_id, url""")
def rag_pages(spark, d):
    """Results of each query by URL, with all their pieces whole."""
    rows = _results(spark, d, 10).withColumn("key", F.struct("query_id", "url")).drop("doc_id", "query_id", "url")
    out = r.pages_of(rows, "key")
    return out.select("key.query_id", "key.url", "lang", F.round("similarity", 6).alias("similarity"), "crawled_at", "n_chunks", F.sha2("content", 256).alias("content_sha256"))


_DECAY = f"CASE WHEN crawled_at IS NULL OR crawled_at >= {_NOW} THEN 1.0 ELSE greatest(pow(0.5, ({_NOW} - crawled_at) / 86400.0 / 14), 0.1) END"


@_query(f"""SELECT query_id, doc_id, round({_DECAY}, 6) AS decay, round(0.7 * s + 0.3 * {_DECAY}, 6) AS score,
row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * s + 0.3 * {_DECAY} DESC, doc_id) AS place FROM ({_FIRST})""")
def recency_order(spark, d):
    out = r.recent_first(_results(spark, d, 10), float(_NOW), by="query_id", tie="doc_id")
    return out.select("query_id", "doc_id", F.round("decay", 6).alias("decay"), F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place"))


@_query(f"""WITH l AS (SELECT * FROM ({_FIRST}) WHERE rank <= 5), f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf, max(crawled_at) AS crawled_at FROM l GROUP BY doc_id)
SELECT doc_id, round(rrf, 9) AS rrf, round(0.7 * rrf + 0.3 * {_DECAY}, 6) AS score FROM f""")
def multi_query_recency(spark, d):
    """Five results of each query, fused by reciprocal ranks, then weighed by age."""
    lists = _results(spark, d, 5)
    times = lists.groupBy("doc_id").agg(F.max("crawled_at").alias("crawled_at"))
    fused = r.multi_query(lists, "doc_id").drop("similarity").withColumnRenamed("score", "fused").join(times, "doc_id")
    decay = s.recency_decay((F.lit(float(_NOW)) - F.col("crawled_at")) / 86400)
    return fused.select("doc_id", F.round("rrf", 9).alias("rrf"), F.round(s.with_recency(F.col("fused"), decay), 6).alias("score"))


@_query(f"""SELECT query_id, vec_id, round(combined, 6) AS combined, place FROM (SELECT query_id, vec_id, 0.4 * s + 0.6 * ((vec_id % 11) / 10.0) AS combined,
row_number() OVER (PARTITION BY query_id ORDER BY 0.4 * s + 0.6 * ((vec_id % 11) / 10.0) DESC, vec_id) AS place FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10) WHERE place <= 5""")
def combined_score(spark, d):
    """The five best of ten candidates of each query by similarity and confidence."""
    found = _multi(spark, d).withColumn("confidence", (F.col("vec_id") % 11) / 10.0)
    return r.combined_top(found, 5).select("query_id", "vec_id", F.round("combined", 6).alias("combined"), F.col("place").cast("bigint").alias("place"))


@_query(f"""SELECT query_id, round(avg(s), 4) AS mean, max(rank) AS n, CASE WHEN avg(s) >= 0.9 THEN 'very_high' WHEN avg(s) >= 0.7 THEN 'high' WHEN avg(s) >= 0.5 THEN 'medium' ELSE 'low' END AS severity
FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10 GROUP BY query_id""")
def severity_ladder(spark, d):
    return _multi(spark, d).groupBy("query_id").agg(F.round(F.avg("similarity"), 4).alias("mean"), F.max("rank").cast("bigint").alias("n"), s.severity(F.avg("similarity")).alias("severity"))


@_query("SELECT doc_id, source FROM documents WHERE length(trim(text)) > 0 AND n_chars IS NOT NULL AND lower(lang) IN ('de', 'fr')")
def sane_rows(spark, d):
    rows = t.table(spark, d, "documents").where(F.lower("lang").isin("de", "fr"))
    return r.sane(rows, "text", "n_chars").select("doc_id", "source")


@_query("""WITH l AS (SELECT link, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY link)
SELECT link, score, row_number() OVER (ORDER BY score DESC, link) AS place FROM (SELECT link, n / (n + 2.0) AS score FROM l) WHERE score >= 0.5 ORDER BY score DESC, link LIMIT 20""")
def promising_urls(spark, d):
    """The 20 best of the linked addresses whose score reaches the threshold."""
    links = t.table(spark, d, "pages").select("page_id", F.explode(s.links(F.col("html"))).alias("link")).groupBy("link").agg(F.count_distinct("page_id").alias("n"))
    best = links.select("link", (F.col("n") / (F.col("n") + 2.0)).alias("score")).where("score >= 0.5").orderBy(F.desc("score"), "link").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "link")).cast("bigint"))


# URLs -------------------------------------------------------------------------------------------


@_query("SELECT page_id, regexp_matches(url, '" + "|".join(u.LEFT_OUT) + "') AS own, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda h: regexp_matches(h, '" + "|".join(u.LEFT_OUT) + "'))) AS n_links FROM pages")
def url_filter(spark, d):
    return t.table(spark, d, "pages").select("page_id", u.left_out(F.col("url")).alias("own"), F.size(F.filter(s.links(F.col("html")), u.left_out)).cast("bigint").alias("n_links"))


_REST = "regexp_replace(url, '^https?://', '')"
_FORMS = f"""[url, ' ' || {_REST} || ' ', '...' || {_REST}, 'ftp://' || {_REST}, url || '#part', 'http://http://' || {_REST}, 'https:///' || {_REST}, 'http://10.1.2.' || (page_id % 300) || '/x',
'http://172.' || (page_id % 40) || '.0.1:8080/', 'http://user@host' || page_id || '.internal/a', 'https://[::1]/', 'https://8.8.' || (page_id % 256) || '.8/?q', '', 'raw:<html>', 'http://LOCALHOST/']"""
_IPV4 = "regexp_matches(host, '^\\d{1,3}(\\.\\d{1,3}){3}$')"
_NUM = " + ".join(f"TRY_CAST(split_part(host, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
_PART = " AND ".join(f"TRY_CAST(split_part(host, '.', {i}) AS BIGINT) <= 255" for i in range(1, 5))
_IN = " OR ".join(f"{_NUM} BETWEEN {u.number(lo)} AND {u.number(hi)}" for lo, hi in u.NOT_PUBLIC)
_UNSAFE = f"""(host IN ({", ".join(f"'{n}'" for n in u.LOCAL_NAMES)}) OR {" OR ".join(f"suffix(host, '{n}')" for n in u.LOCAL_SUFFIXES)} OR ({_IPV4} AND {_PART} AND ({_IN})) OR (contains(host, ':') AND regexp_matches(host, '{u.NOT_PUBLIC_6}')))"""


@_query(f"""WITH f AS (SELECT page_id, unnest({_FORMS}) AS url, generate_subscripts({_FORMS}, 1) AS form FROM pages),
b AS (SELECT page_id, form, trim(url) AS bare FROM f),
w AS (SELECT *, CASE WHEN contains(bare, '/') AND NOT regexp_matches(bare, '^(https?://|file://|raw:)') AND regexp_matches(bare, '^[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}(/.*)?$') THEN 'https://' || bare ELSE bare END AS whole FROM b),
h AS (SELECT *, regexp_matches(whole, '^https?://') AS web, regexp_replace(regexp_extract(whole, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS place FROM w),
n AS (SELECT *, lower(CASE WHEN prefix(place, '[') THEN regexp_extract(place, '^\\[([^\\]]*)\\]', 1) ELSE regexp_replace(place, ':.*$', '') END) AS host FROM h),
e AS (SELECT *, CASE WHEN bare = '' THEN 'empty' WHEN prefix(bare, '...') THEN 'truncated' WHEN NOT regexp_matches(whole, '^(https?://|raw:)') THEN 'scheme'
WHEN web AND len(string_split(whole, '://')) > 2 THEN 'protocols' WHEN web AND regexp_matches(whole, '^https?://(/|$)') THEN 'domain' WHEN web AND host = '' THEN 'host' WHEN web AND {_UNSAFE} THEN 'unsafe' END AS error FROM n)
SELECT page_id, form, error IS NULL AS valid, CASE WHEN error IS NULL THEN regexp_replace(whole, '#.*$', '') END AS url, error FROM e""")
def url_validation(spark, d):
    """Fifteen forms of every page's address, checked as a crawler would."""
    rest, page = F.regexp_replace("url", "^https?://", ""), F.col("page_id")
    text = lambda v: v.cast("string")
    cat = lambda *p: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in p])
    forms = [
        F.col("url"), cat(" ", rest, " "), cat("...", rest), cat("ftp://", rest), cat(F.col("url"), "#part"), cat("http://http://", rest), cat("https:///", rest), cat("http://10.1.2.", text(page % 300), "/x"),
        cat("http://172.", text(page % 40), ".0.1:8080/"), cat("http://user@host", text(page), ".internal/a"), F.lit("https://[::1]/"), cat("https://8.8.", text(page % 256), ".8/?q"), F.lit(""), F.lit("raw:<html>"), F.lit("http://LOCALHOST/"),
    ]
    rows = t.table(spark, d, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "given"))
    return rows.select("page_id", (F.col("form") + 1).cast("bigint").alias("form"), u.checked(F.col("given")).alias("found")).select("page_id", "form", "found.*")


@_query("""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'o' || (page_id % 7) END AS owner, CASE WHEN page_id % 3 < 2 THEN 'r' || page_id END AS name, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '') AS source_id FROM pages""")
def repository_urls(spark, d):
    page = F.col("page_id")
    owner, name = F.concat(F.lit("o"), (page % 7).cast("string")), F.concat(F.lit("r"), page.cast("string"))
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)
    given = F.when(page % 3 == 0, base).when(page % 3 == 1, F.concat(base, F.lit(".git"))).otherwise(F.concat(base, F.lit("/tree/main")))
    return t.table(spark, d, "pages").select("page_id", u.repository(given).alias("repo"), u.source_id(F.col("url")).alias("source_id")).select("page_id", "repo.owner", "repo.name", "source_id")


@_query("""SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 0 ELSE len(regexp_extract_all(html, 'href="([^"]*)"', 1)) END AS n,
CASE WHEN page_id % 7 = 3 THEN '' ELSE coalesce(array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' '), '') END AS locations FROM pages""")
def sitemap_locations(spark, d):
    """Sitemaps of every page's links; one in seven is not well-formed and gives nothing."""
    entries = F.transform(s.links(F.col("html")), lambda h: F.concat(F.lit("<url><loc>"), F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")))
    end = F.when(F.col("page_id") % 7 == 3, "").otherwise("</urlset>")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc></loc></url>'), F.array_join(entries, ""), end)
    found = u.sitemap_locations(xml)
    return t.table(spark, d, "pages").select("page_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, " ").alias("locations"))


# Markdown and arguments -------------------------------------------------------------------------

_MARKED = "regexp_replace(text, '(^|\\n)([A-Z])', '\\1## \\2', 'g')"


@_query(f"""WITH m AS (SELECT doc_id, {_MARKED} AS md FROM documents)
SELECT doc_id, sha256(coalesce(array_to_string(list_transform(list_filter(string_split(md, chr(10)), lambda l: regexp_matches(l, '^#+[ \\t]+.+$')), lambda l: regexp_replace(l, '^(#+)[ \\t]+', '\\1 ')), '; '), '')) AS headers_sha256 FROM m""")
def section_headers(spark, d):
    marked = F.regexp_replace("text", "(^|\\n)([A-Z])", "$1## $2")
    return t.table(spark, d, "documents").select("doc_id", F.sha2(x.headers(marked), 256).alias("headers_sha256"))


_FENCED = "regexp_replace(text, '\\. ', '.' || chr(10) || '```py' || chr(10), 'g')"


@_query(f"""WITH m AS (SELECT doc_id, {_FENCED} AS md FROM documents),
p AS (SELECT doc_id, md, string_split(md, '```') AS parts FROM m),
k AS (SELECT doc_id, md, parts, unnest(range(2, len(parts), 2)) AS i FROM p),
l AS (SELECT doc_id, i, md, parts[i] AS part, length(array_to_string(parts[1:i - 1], '```')) AS start, trim(split_part(parts[i], chr(10), 1), ' ' || chr(9) || chr(10) || chr(13)) AS head FROM k),
n AS (SELECT *, contains(part, chr(10)) AND head <> '' AND NOT contains(head, ' ') AND length(head) < 20 AS named FROM l),
b AS (SELECT *, CASE WHEN named THEN head ELSE '' END AS language, CASE WHEN named THEN part[strpos(part, chr(10)) + 1:] ELSE part END AS code FROM n)
SELECT doc_id, i // 2 AS block, language, sha256(code) AS code_sha256,
length(trim(md[greatest(1, start - 999):start], ' ' || chr(9) || chr(10) || chr(13))) AS n_before, length(trim(substr(md, start + length(part) + 7, 1000), ' ' || chr(9) || chr(10) || chr(13))) AS n_after
FROM b WHERE length(code) >= 40""")
def code_blocks(spark, d):
    """Code blocks of documents whose sentences are fenced by turns."""
    fenced = F.regexp_replace("text", "\\. ", ".\n```py\n")
    rows = t.table(spark, d, "documents").select("doc_id", F.filter(F.transform(x.code_blocks(fenced, least=0), lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda e: F.length(e["b"]["code"]) >= 40).alias("found"))
    rows = rows.select("doc_id", F.inline("found"))
    size = lambda k: F.length(F.col("b")[k]).cast("bigint")
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("block"), "b.language", F.sha2("b.code", 256).alias("code_sha256"), size("before").alias("n_before"), size("after").alias("n_after"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN doc_id % 2 = 0 THEN lang || '+' || trim(source) ELSE source END AS given FROM documents")
def list_arguments(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", F.concat(F.lit(" "), "source", F.lit(" "))))).otherwise(F.col("source"))
    found = x.trimmed(x.list_argument(text))
    return t.table(spark, d, "documents").select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, "+").alias("given"))


@_query("""SELECT source, topic, CASE WHEN topic = 'de' THEN 'given' ELSE source || ' ' || topic END AS query FROM (SELECT DISTINCT source, lang AS topic FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""")
def topic_fill(spark, d):
    topics = t.table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.collect_set("lang").alias("topics"))
    given = F.create_map(F.lit("de"), F.lit("given"))
    return topics.select("source", F.explode(x.topic_queries(F.col("source"), F.col("topics"), given)).alias("topic", "query"))


@_query("""SELECT doc_id, key, value FROM (SELECT doc_id, unnest(['a', 'b', 'c']) AS key, unnest([source, lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'n' || doc_id END]) AS value FROM documents) WHERE value <> ''""")
def map_merge(spark, d):
    """Maps merged with the right one's values winning, without what is empty."""
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("lang"))
    new = F.create_map(F.lit("a"), F.col("source"), F.lit("c"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string"))))
    return t.table(spark, d, "documents").select("doc_id", F.explode(x.present(x.merged(old, new))))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id * 1.5::DOUBLE WHEN page_id % 3 = 1 THEN page_id * 1.5::DOUBLE * 1024 END AS mb FROM pages")
def size_units(spark, d):
    page = (F.col("page_id") * 1.5).cast("string")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(page, F.lit(" MiB"))).when(F.col("page_id") % 3 == 1, F.concat(page, F.lit("G"))).otherwise("large")
    return t.table(spark, d, "pages").select("page_id", x.megabytes(given).alias("mb"))


# tables by URL ----------------------------------------------------------------------------------

_CHUNKS = "SELECT source || '/' || (doc_id % 7) AS url, doc_id AS chunk_number, lang AS content, CASE WHEN doc_id % 2 = 0 THEN source END AS source_id FROM documents"


def _chunk_rows(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    return t.table(spark, d, "documents").select(F.concat("source", F.lit("/"), (doc % 7).cast("string")).alias("url"), doc.alias("chunk_number"), F.col("lang").alias("content"), F.when(doc % 2 == 0, F.col("source")).alias("source_id"))


@_query(f"""WITH c AS (SELECT url, chunk_number, content, coalesce(source_id, regexp_replace(url, '^www\\.', '')) AS source_id FROM ({_CHUNKS}) WHERE url IS NOT NULL),
n AS (SELECT url, -chunk_number AS chunk_number, 'new' AS content, regexp_replace(url, '^www\\.', '') AS source_id FROM ({_CHUNKS}) WHERE chunk_number % 10 = 0 AND url IS NOT NULL)
SELECT * FROM c WHERE url NOT IN (SELECT url FROM n) UNION ALL SELECT DISTINCT * FROM n""")
def documents_added(spark, d):
    """New chunks replace all old ones of their URLs; sources are filled in."""
    rows = _chunk_rows(spark, d).where("url IS NOT NULL")
    new = rows.where("chunk_number % 10 = 0").select("url", (-F.col("chunk_number")).alias("chunk_number"), F.lit("new").alias("content"), F.lit(None).cast("string").alias("source_id"))
    return t.add_documents(t.documents(rows), new).drop("point_id")


@_query(f"SELECT 'code_' || url || '_' || chunk_number AS code_id, CASE WHEN chunk_number % 3 = 0 THEN 'new' ELSE content END AS content FROM ({_CHUNKS}) WHERE url IS NOT NULL")
def code_examples_added(spark, d):
    rows = _chunk_rows(spark, d).where("url IS NOT NULL").drop("source_id").distinct()
    return t.add_code_examples(rows, rows.where("chunk_number % 3 = 0").withColumn("content", F.lit("new"))).select("code_id", "content")


@_query(f"SELECT url, chunk_number, content FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY chunk_number) AS k FROM ({_CHUNKS}) WHERE suffix(url, '/3')) WHERE k <= 1000")
def docs_by_url(spark, d):
    rows = _chunk_rows(spark, d)
    return t.by_url(rows, rows.where(F.col("url").endswith("/3"))).select("url", "chunk_number", "content")


@_query(f"SELECT DISTINCT url, url IN (SELECT url FROM ({_CHUNKS}) WHERE chunk_number % 20 = 0 AND url IS NOT NULL) AS known FROM ({_CHUNKS}) WHERE url IS NOT NULL")
def url_exists(spark, d):
    rows = _chunk_rows(spark, d).where("url IS NOT NULL")
    return t.known_urls(rows, rows.where("chunk_number % 20 = 0"))


@_query("""WITH o AS (SELECT source AS source_id, min(lang) AS summary, count(*) AS total_words FROM documents WHERE source IS NOT NULL GROUP BY source),
n AS (SELECT DISTINCT source || 'x' AS source_id FROM documents WHERE source IS NOT NULL AND source < 'src3' UNION SELECT DISTINCT source FROM documents WHERE source >= 'src3')
SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.source_id IS NOT NULL THEN 'fresh' ELSE o.summary END AS summary, coalesce(o.total_words, 0) AS total_words,
CASE WHEN n.source_id IS NOT NULL THEN 'new' ELSE 'old' END AS origin FROM o FULL JOIN n ON o.source_id = n.source_id""")
def source_merge(spark, d):
    """Sources updated where they are known, added where they are not."""
    docs = t.table(spark, d, "documents").where("source IS NOT NULL")
    old = docs.groupBy(F.col("source").alias("source_id")).agg(F.min("lang").alias("summary"), F.count(F.lit(1)).alias("total_words")).withColumn("payload", F.create_map(F.lit("origin"), F.lit("old")))
    named = F.when(F.col("source") < "src3", F.concat("source", F.lit("x"))).otherwise(F.col("source"))
    new = docs.select(named.alias("source_id")).distinct().select("source_id", F.lit("fresh").alias("summary"), F.lit(None).cast("bigint").alias("total_words"), F.create_map(F.lit("origin"), F.lit("new")).alias("payload"))
    out = t.merge_sources(old, new)
    return t.sources_listed(out).join(out.select("source_id", F.col("payload")["origin"].alias("origin")), "source_id")


@_query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_type = 'ECONOMY') WHERE k <= 10")
def code_by_repository(spark, d):
    """Ten examples of one kind of each repository (brands and types stand in for them)."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return t.table(spark, d, "part").where("p_type = 'ECONOMY'").withColumn("k", rank).where("k <= 10").select("p_partkey", "p_name")


@_query("SELECT ext, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, lower(regexp_extract(regexp_replace(link, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)) GROUP BY ext")
def extension_histogram(spark, d):
    links = t.table(spark, d, "pages").select("page_id", F.explode(s.links(F.col("html"))).alias("link"))
    ext = F.lower(F.regexp_extract(F.regexp_replace("link", "[?#].*$", ""), "\\.([A-Za-z0-9]+)$", 1))
    return links.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


# validation -------------------------------------------------------------------------------------

# parts are modules (brand) with symbols (type); a line of an order is a use whose call has l_quantity % 5 arguments
_USES = "SELECT l_orderkey, l_linenumber, 'Brand#' || (l_partkey % 30) AS module, CASE WHEN l_suppkey % 4 = 0 THEN 'MISSING' ELSE p_type END AS symbol, l_quantity::BIGINT % 5 AS n_args, l_linenumber % 3 AS n_kw FROM lineitem JOIN part ON p_partkey = l_partkey"
_STATUS = f"""SELECT u.*, m.module IS NOT NULL AS in_graph, CASE WHEN m.module IS NULL THEN 'UNCERTAIN' WHEN y.symbol IS NULL THEN 'NOT_FOUND' WHEN n_args > 3 OR n_args < 2 OR n_kw = 2 THEN 'INVALID' ELSE 'VALID' END AS status,
CASE WHEN m.module IS NULL THEN 0.8 WHEN y.symbol IS NULL THEN 0.2 WHEN n_args > 3 OR n_args < 2 THEN 0.8 WHEN n_kw = 2 THEN 0.7 ELSE 0.8 END AS confidence
FROM ({_USES}) u LEFT JOIN (SELECT DISTINCT p_brand AS module FROM part) m USING (module) LEFT JOIN (SELECT DISTINCT p_brand AS module, p_type AS symbol FROM part) y ON y.module = u.module AND y.symbol = u.symbol"""


def _uses(spark, d) -> tuple[DataFrame, DataFrame]:
    part = t.table(spark, d, "part")
    symbols = part.select(F.col("p_brand").alias("module"), F.col("p_type").alias("symbol"), F.array(*[F.lit(v) for v in ("self", "a:int", "b:str", "c:str=None", "[keyword_only] k:int=1")]).alias("expected"))
    lines = t.table(spark, d, "lineitem").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    names = F.when(F.col("l_linenumber") % 3 == 2, F.array(F.lit("zz"))).when(F.col("l_linenumber") % 3 == 1, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    uses = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (F.col("l_partkey") % 30).cast("string")).alias("module"), F.when(F.col("l_suppkey") % 4 == 0, "MISSING").otherwise(F.col("p_type")).alias("symbol"), (F.col("l_quantity").cast("bigint") % 5).alias("n_args"), names.alias("kwargs"))
    return uses, symbols


def _checked(spark, d) -> DataFrame:
    uses, symbols = _uses(spark, d)
    return c.usages(uses, symbols, symbols)


@_query(f"SELECT l_orderkey, l_linenumber, in_graph, status, confidence::DOUBLE AS confidence FROM ({_STATUS})")
def usage_validation(spark, d):
    return _checked(spark, d).select("l_orderkey", "l_linenumber", "in_graph", "status", "confidence")


@_query(f"SELECT l_orderkey, round(coalesce(avg(CASE WHEN in_graph THEN confidence END), 1.0), 6) AS confidence FROM ({_STATUS}) GROUP BY l_orderkey")
def overall_confidence(spark, d):
    return c.overall(_checked(spark, d), "l_orderkey").withColumn("confidence", F.round("confidence", 6))


@_query(f"""SELECT module, total, valid, invalid, not_found, uncertain, round((invalid + not_found) / greatest(1, valid + invalid + not_found), 6) AS hallucination_rate FROM (SELECT module, count(*) AS total,
count_if(status = 'VALID') AS valid, count_if(status = 'INVALID') AS invalid, count_if(status = 'NOT_FOUND') AS not_found, count_if(status = 'UNCERTAIN') AS uncertain FROM ({_STATUS}) GROUP BY module)""")
def report_summary(spark, d):
    return c.report(_checked(spark, d), "module").withColumn("hallucination_rate", F.round("hallucination_rate", 6))


@_query(f"""SELECT symbol, count(*) AS total, count_if(status = 'VALID') AS validated, round(count_if(status = 'VALID') / count(*), 6) AS validation_rate, round(count_if(confidence >= 0.8) / count(*), 6) AS high_confidence_rate FROM ({_STATUS}) GROUP BY symbol""")
def validation_summary(spark, d):
    out = c.rates(_checked(spark, d).withColumn("validated", F.col("status") == "VALID"), "symbol")
    return out.withColumns({n: F.round(n, 6) for n in ("validation_rate", "high_confidence_rate")})


@_query(f"SELECT module, count(*) AS n, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM ({_STATUS}) WHERE in_graph GROUP BY module")
def library_summary(spark, d):
    return _checked(spark, d).where("in_graph").groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


@_query(f"""SELECT l_orderkey, bad, confidence FROM (SELECT l_orderkey, count_if(status IN ('INVALID', 'NOT_FOUND')) AS bad, round(avg(confidence), 6) AS confidence FROM ({_STATUS}) GROUP BY l_orderkey) ORDER BY bad DESC, l_orderkey LIMIT 5""")
def batch_summary(spark, d):
    """The five orders with most wrong uses."""
    out = _checked(spark, d).groupBy("l_orderkey").agg(F.count_if(F.col("status").isin("INVALID", "NOT_FOUND")).alias("bad"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return out.orderBy(F.desc("bad"), "l_orderkey").limit(5)


_MIXED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['self', 'a:int', 'b:int=1'] WHEN 2 THEN ['a:int', '*args', '[keyword_only] k:int'] ELSE ['[keyword_only] k:int=2', '**kw', 'a:x'] END AS expected, p_size % 4 AS n_args, CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN ['k'] ELSE ['b', 'q'] END AS kwargs FROM part"


@_query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'UNCERTAIN'
WHEN p_partkey % 4 = 1 THEN CASE WHEN n_args > 2 OR n_args < 1 OR len(list_filter(kwargs, lambda k: k NOT IN ('a', 'b'))) > 0 THEN 'INVALID' ELSE 'VALID' END
WHEN p_partkey % 4 = 2 THEN CASE WHEN n_args < 1 OR len(list_filter(kwargs, lambda k: k NOT IN ('a', 'k'))) > 0 OR NOT list_contains(kwargs, 'k') THEN 'INVALID' ELSE 'VALID' END
ELSE CASE WHEN n_args <> 1 THEN 'INVALID' ELSE 'VALID' END END AS status FROM ({_MIXED})""")
def param_validation(spark, d):
    key, strings = F.col("p_partkey") % 4, lambda *v: F.array(*[F.lit(e) for e in v]).cast("array<string>")
    expected = F.when(key == 0, strings()).when(key == 1, strings("self", "a:int", "b:int=1")).when(key == 2, strings("a:int", "*args", "[keyword_only] k:int")).otherwise(strings("[keyword_only] k:int=2", "**kw", "a:x"))
    size = F.col("p_size") % 3
    kwargs = F.when(size == 0, strings()).when(size == 1, strings("k")).otherwise(strings("b", "q"))
    return t.table(spark, d, "part").select("p_partkey", c.parameters(expected, F.col("p_size") % 4, kwargs)["status"].alias("status"))


_OWN = "SELECT f.head, f.repo, count(*) AS n FROM (SELECT string_split(p_name, ' ')[1] AS head, p_brand AS repo FROM part) f GROUP BY f.head, f.repo"


@_query(f"""SELECT module, repo, n, rank FROM (SELECT m.module, o.repo, o.n, row_number() OVER (PARTITION BY m.module ORDER BY o.n DESC, o.repo) AS rank FROM (SELECT DISTINCT replace(p_name, ' ', '.') AS module, string_split(p_name, ' ')[1] AS head FROM part) m JOIN ({_OWN}) o USING (head)) WHERE rank <= 5""")
def module_owner(spark, d):
    """Which repositories (brands) own a module (the dotted name of a part)."""
    dotted = t.table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("module"), F.col("p_brand").alias("repo"))
    return c.owners(dotted.select("module"), dotted.select(F.col("module").alias("file_module"), "repo")).select("module", "repo", F.col("n"), F.col("rank").cast("bigint").alias("rank"))


_ASKED = "SELECT DISTINCT upper(replace(n_name, ' ', '_')) AS asked FROM nation UNION SELECT DISTINCT lower(left(n_name, 4)) FROM nation"


@_query(f"""SELECT asked, name, rank FROM (SELECT asked, name, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN n = a THEN 1 WHEN contains(n, a) THEN 2 ELSE 3 END, name) AS rank FROM (SELECT asked, replace(lower(asked), '-', '_') AS a FROM ({_ASKED})) x
JOIN (SELECT n_name AS name, replace(lower(n_name), '-', '_') AS n FROM nation) y ON contains(n, a) OR contains(a, n)) WHERE rank <= 5""")
def fuzzy_repository(spark, d):
    names = t.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    asked = names.select(F.upper(F.replace("name", F.lit(" "), F.lit("_"))).alias("asked")).union(names.select(F.lower(F.left("name", F.lit(4))))).distinct()
    return c.fuzzy_names(asked, names).withColumn("rank", F.col("rank").cast("bigint"))


@_query("""SELECT asked, name, rank FROM (SELECT a.n_name AS asked, b.n_name AS name, row_number() OVER (PARTITION BY a.n_name ORDER BY b.n_name) AS rank FROM nation a JOIN nation b ON a.n_name <> b.n_name AND contains(lower(b.n_name), lower(left(a.n_name, 3)))) WHERE rank <= 5""")
def similar_names(spark, d):
    names = t.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return c.similar_names(names.withColumnRenamed("name", "asked"), names).withColumn("rank", F.col("rank").cast("bigint"))


@_query("""SELECT n_name, count(c_custkey) AS n, coalesce(string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey), '') AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def class_methods(spark, d):
    """Classes with their methods nested (nations and customers stand in for them)."""
    own = t.table(spark, d, "nation").join(t.table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    nested = own.groupBy("n_name").agg(F.count("c_custkey").alias("n"), F.array_sort(F.collect_list(F.when(F.col("c_custkey").isNotNull(), F.struct("c_custkey", "c_mktsegment")))).alias("members"))
    return nested.select("n_name", "n", F.array_join(F.transform("members", lambda m: F.concat(m["c_custkey"].cast("string"), F.lit(":"), m["c_mktsegment"])), ",").alias("members"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NOT NULL THEN 'attribute' WHEN n_nationkey IS NOT NULL THEN 'method' END AS kind FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = l_suppkey""")
def attribute_or_method(spark, d):
    """An attribute of the name, else a method of it, else nothing."""
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    found = lines.join(t.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t.table(spark, d, "nation").select("n_nationkey"), F.col("l_suppkey") == F.col("n_nationkey"), "left")
    return found.select("l_orderkey", "l_linenumber", F.when(F.col("s_suppkey").isNotNull(), "attribute").when(F.col("n_nationkey").isNotNull(), "method").alias("kind"))


@_query("""SELECT p_brand, economy, standard, promo, n_types FROM (SELECT p_brand, count_if(p_type = 'ECONOMY') AS economy, count_if(p_type = 'STANDARD') AS standard, count_if(p_type = 'PROMO') AS promo, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand)""")
def extraction_summary(spark, d):
    n = lambda k: F.count_if(F.col("p_type") == k)
    return t.table(spark, d, "part").groupBy("p_brand").agg(n("ECONOMY").alias("economy"), n("STANDARD").alias("standard"), n("PROMO").alias("promo"), F.count_distinct("p_type").alias("n_types"))


@_query("""SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS per_second, round(count_if(value >= 50) / count(*), 6) AS hit_rate FROM events GROUP BY event_type""")
def throughput(spark, d):
    """Extremes, rows a second and the share of hits by kind of event."""
    at = F.col("ts").cast("timestamp").cast("double")
    return t.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.count(F.lit(1)) / F.greatest(F.max(at) - F.min(at), F.lit(1.0)), 9).alias("per_second"), F.round(F.count_if(F.col("value") >= 50) / F.count(F.lit(1)), 6).alias("hit_rate"))


# the type of every seventh line's variable is unknown; even lines are calls, odd ones read an attribute
_TYPED = f"SELECT u.*, CASE WHEN l_linenumber = 7 THEN NULL ELSE module END AS type FROM ({_USES}) u"
_METHOD_STATUS = f"""SELECT l_orderkey, l_linenumber, u.symbol, CASE WHEN type IS NULL OR m.module IS NULL THEN 'UNCERTAIN' WHEN y.symbol IS NULL THEN 'NOT_FOUND' WHEN n_args > 3 OR n_args < 2 OR n_kw = 2 THEN 'INVALID' ELSE 'VALID' END AS status,
(CASE WHEN type IS NULL THEN 0.3 WHEN m.module IS NULL THEN 0.8 WHEN y.symbol IS NULL THEN 0.1 WHEN n_args > 3 OR n_args < 2 THEN 0.8 WHEN n_kw = 2 THEN 0.7 ELSE 0.9 END)::DOUBLE AS confidence
FROM ({_TYPED}) u LEFT JOIN (SELECT DISTINCT p_brand AS module FROM part) m ON m.module = type LEFT JOIN (SELECT DISTINCT p_brand AS module, p_type AS symbol FROM part) y ON y.module = type AND y.symbol = u.symbol"""


def _method_calls(spark, d) -> DataFrame:
    uses, symbols = _uses(spark, d)
    typed = uses.withColumn("module", F.when(F.col("l_linenumber") != 7, F.col("module")))
    return c.methods(typed, symbols, symbols)


@_query(f"SELECT l_orderkey, l_linenumber, status, confidence FROM ({_METHOD_STATUS})")
def method_validation(spark, d):
    return _method_calls(spark, d).select("l_orderkey", "l_linenumber", "status", "confidence")


@_query(f"""SELECT script, symbol, type, count(*) AS n FROM (
SELECT DISTINCT l_orderkey % 500 AS script, l_linenumber AS line, symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'METHOD' ELSE 'ATTRIBUTE' END || '_NOT_FOUND' AS type FROM ({_METHOD_STATUS}) WHERE status = 'NOT_FOUND'
UNION ALL SELECT l_orderkey % 500, l_linenumber, symbol, 'INVALID_PARAMETERS' FROM ({_METHOD_STATUS}) WHERE status = 'INVALID') GROUP BY script, symbol, type""")
def hallucination_list(spark, d):
    """What is wrong in each script (orders by number stand in for scripts, their lines for lines)."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "method").otherwise("attribute")
    checked = _method_calls(spark, d).select((F.col("l_orderkey") % 500).alias("script"), F.col("l_linenumber").alias("line"), "symbol", "status", kind.alias("kind"))
    return c.hallucinations(checked, "script", "line").groupBy("script", "symbol", "type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT script, round(graph, 6) AS graph, round(semantic, 6) AS semantic, round(0.6 * graph + 0.4 * semantic, 6) AS combined FROM (
SELECT l_orderkey AS script, coalesce(avg(CASE WHEN status <> 'UNCERTAIN' THEN confidence END), 0.5) AS graph, coalesce(avg(CASE WHEN l_linenumber % 3 = 0 THEN confidence / 2 END), 0.5) AS semantic FROM ({_METHOD_STATUS}) GROUP BY l_orderkey)""")
def combined_confidence(spark, d):
    confidence = F.col("confidence")
    rows = _method_calls(spark, d).select(F.col("l_orderkey").alias("script"), F.when(F.col("status") != "UNCERTAIN", confidence).alias("graph_confidence"), F.when(F.col("l_linenumber") % 3 == 0, confidence / 2).alias("semantic_confidence"))
    return c.combined(rows, "script").select("script", *[F.round(x, 6).alias(x) for x in ("graph", "semantic", "combined")])


# code -------------------------------------------------------------------------------------------

# customers are classes, their orders methods; a class's text holds the first five
_METHODS = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders"
_STUB = f"""SELECT c_custkey, 'class Customer' || c_custkey || ':' || chr(10) || '    \"\"\"Class with the following public methods:\"\"\"' || chr(10) ||
coalesce(string_agg('    def order' || o_orderkey || '(self, day: int=' || (o_orderkey % 9) || ', *rest, key: str) -> ' || CASE WHEN o_orderstatus = 'F' THEN 'Any' ELSE 'Dict[str, int]' END || ': ...' || chr(10), '' ORDER BY o_orderkey), '    pass' || chr(10)) AS code
FROM customer LEFT JOIN ({_METHODS}) ON o_custkey = c_custkey AND k <= 5 GROUP BY c_custkey"""


def _stubs(spark, d) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    params = F.array(F.lit("self"), F.concat(F.lit("day: int="), (F.col("o_orderkey") % 9).cast("string")), F.lit("*rest"), F.lit("key: str"))
    method = F.struct(F.col("k"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"), params.alias("params_list"), F.when(F.col("o_orderstatus") != "F", "Dict[str, int]").alias("return_type"))
    first = t.table(spark, d, "orders").withColumn("k", order).where("k <= 5").groupBy("o_custkey").agg(F.array_sort(F.collect_list(method)).alias("methods"))
    own = t.table(spark, d, "customer").select("c_custkey").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    name = F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"))
    return own.select("c_custkey", k.class_stub(name, F.coalesce("methods", F.array().cast("array<struct<k:int,name:string,params_list:array<string>,return_type:string>>"))).alias("code"))


@_query(f"SELECT c_custkey, length(code) AS n_chars, sha256(code) AS code_sha256 FROM ({_STUB})")
def class_stubs(spark, d):
    return _stubs(spark, d).select("c_custkey", F.length("code").cast("bigint").alias("n_chars"), F.sha2("code", 256).alias("code_sha256"))


@_query(f"""SELECT 'c' || c_custkey || '.py' AS path, 'class' AS kind, '' AS owner, 'Customer' || c_custkey AS name, '' AS params, NULL AS returns FROM customer UNION ALL
SELECT 'c' || c_custkey || '.py', 'method', 'Customer' || c_custkey, 'order' || o_orderkey, 'day:int=' || (o_orderkey % 9) || ';[var_positional] *rest:Any=None;[keyword_only] key:str', CASE WHEN o_orderstatus = 'F' THEN 'Any' ELSE 'Dict[str, int]' END
FROM customer JOIN ({_METHODS}) ON o_custkey = c_custkey AND k <= 5""")
def python_symbols(spark, d):
    """The symbols of the classes' texts, parsed back."""
    files = _stubs(spark, d).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.col("code").alias("content"))
    return k.python_symbols(files).select("path", "kind", "owner", "name", F.array_join("params", ";").alias("params"), "returns")


@_query(f"""SELECT o_orderkey, CASE WHEN k <= 5 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'INVALID' ELSE 'VALID' END ELSE 'NOT_FOUND' END AS status FROM ({_METHODS}) JOIN customer ON o_custkey = c_custkey""")
def script_validation(spark, d):
    """Scripts that call each order's method, held against the symbols of the classes' texts."""
    known = t.table(spark, d, "customer").select("c_custkey")
    key, owner = F.col("o_orderkey").cast("string"), F.concat(F.lit("Customer"), F.col("o_custkey").cast("string"))
    call = F.when(F.col("o_orderkey") % 4 == 0, "(1, 2, 3, 4, other=1)").otherwise("(*given, key='a')")
    script = F.concat(F.lit("from shop import "), owner, F.lit("\nc = "), owner, F.lit("()\nc.order"), key, call, F.lit("\n"))
    scripts = t.table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(key.alias("path"), script.alias("content"))
    calls = k.python_uses(scripts).where("kind = 'method'").select("path", F.col("owner").alias("module"), F.col("name").alias("symbol"), "n_args", "kwargs")
    files = _stubs(spark, d).select(F.col("c_custkey").cast("string").alias("path"), F.col("code").alias("content"))
    # both read the symbols, and they are counted
    found = t.stored(k.python_symbols(files), "symbols")
    classes = found.where("kind = 'class'").select(F.concat(F.lit("shop."), "name").alias("module"))
    methods = found.where("kind = 'method'").select(F.concat(F.lit("shop."), "owner").alias("module"), F.col("name").alias("symbol"), F.col("params").alias("expected"))
    return c.usages(calls, classes, methods).select(F.col("path").cast("bigint").alias("o_orderkey"), "status")
