"""Registered queries of the vector and the keyword index, of the composed search, and of crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl
from ..operators import keyword_index as kw
from ..operators import markdown as md
from ..operators import rag
from ..operators import rerank as rr
from ..operators import vector_index as vi
from ..sources import tables as t
from .catalog import _query, _targets


def _indexed(spark, d):
    rows = t.table(spark, d, "embeddings")
    return vi.build(rows, t.stored), _targets(spark, d, "vec_id % 50 = 0")


@_query()
def vec_index_topk(spark, d):
    """The ten nearest of each query among the cells that it probes (recall against all rows is measured in tests)."""
    index, asked = _indexed(spark, d)
    return vi.search(index, asked, 10).select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@_query(f"""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, a.vec_id) AS rank
FROM embeddings a JOIN embeddings q ON a.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def vec_index_exact(spark, d):
    """The same with all cells probed: the exact way over the index."""
    index, asked = _indexed(spark, d)
    return vi.search(index, asked, 10, probes=len(index.centres)).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


_WORDS = "SELECT DISTINCT regexp_extract(text, '^[^ ]+ [^ ]+') AS keyword FROM benchmark UNION SELECT DISTINCT regexp_extract(text, '[^ ]+$') FROM benchmark UNION SELECT * FROM (VALUES ('Licensed Under'), ('qu'), ('%'), ('no such words'))"


@_query(f"SELECT keyword, doc_id FROM ({_WORDS}) k JOIN documents ON contains(lower(text), lower(keyword))")
def keyword_search(spark, d):
    """Documents that hold the first two or the last word of each benchmark item, and a few short and odd keywords."""
    docs, items = t.table(spark, d, "documents"), t.table(spark, d, "benchmark")
    own = spark.createDataFrame([("Licensed Under",), ("qu",), ("%",), ("no such words",)], "keyword string")
    words = items.select(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0).alias("keyword")).union(items.select(F.regexp_extract("text", "[^ ]+$", 0))).union(own)
    return kw.search(kw.build(docs, t.stored), docs, words)


# the composed search: vectors of documents are chunks, their sources sites; every third query asks one site, the others any

_NOW = 1_706_659_200
_ROWS = "SELECT doc_id AS chunk_id, source AS source_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE source || '/' || (doc_id % 7) END AS url, doc_id AS chunk_number, text AS content, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 0 ELSE 1700000000 + doc_id * 3600 END AS crawled_at, embedding FROM documents JOIN embeddings ON vec_id = doc_id"
_ASKED = "SELECT vec_id AS query_id, embedding AS query, CASE WHEN vec_id % 100 = 0 THEN 'Licensed Under' ELSE 'the' END AS words, CASE WHEN vec_id % 150 = 0 THEN ' src' || (vec_id % 4) || ' ' ELSE '  ' END AS source, vec_id // 200 AS search FROM embeddings WHERE vec_id % 50 = 0"
_NEAR = "list_cosine_similarity(r.embedding::DOUBLE[], q.query::DOUBLE[])"
_IN = f"FROM ({_ASKED}) q JOIN ({_ROWS}) r ON trim(q.source) = '' OR trim(q.source) = r.source_id"
_DECAY = f"CASE WHEN crawled_at IS NULL OR crawled_at >= {_NOW} THEN 1.0 ELSE greatest(pow(0.5, ({_NOW} - crawled_at) / 86400.0 / 14), 0.1) END"


def _best(n: int) -> str:
    return f"SELECT * FROM (SELECT q.query_id, q.search, r.* EXCLUDE (embedding), {_NEAR} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_NEAR} DESC, chunk_id) AS rank {_IN}) WHERE rank <= {n}"


def _paged(found: str) -> str:
    return f"""WITH f AS ({found}), p AS (SELECT query_id, url, arg_min(source_id, rank) AS source_id, max(s) AS s, max(CASE WHEN crawled_at > 0 THEN crawled_at END) AS crawled_at, count(*) AS n_chunks, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_number, rank)) AS content_sha256 FROM f WHERE url <> '' GROUP BY query_id, url)
SELECT query_id, url, source_id, round(s, 6) AS similarity, round(0.7 * s + 0.3 * {_DECAY}, 6) AS score, n_chunks, content_sha256, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * s + 0.3 * {_DECAY} DESC, url) AS place FROM p"""


_KEYS = f"SELECT * FROM (SELECT q.query_id, r.* EXCLUDE (embedding), row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS k {_IN} WHERE contains(lower(content), lower(words))) WHERE k <= 6"
_BOTH = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, coalesce(v.source_id, k.source_id) AS source_id, coalesce(v.url, k.url) AS url, coalesce(v.chunk_number, k.chunk_number) AS chunk_number, coalesce(v.content, k.content) AS content,
coalesce(v.crawled_at, k.crawled_at) AS crawled_at, coalesce(0.7 * v.s, 0) + CASE WHEN k.k IS NOT NULL THEN 0.3 ELSE 0 END AS s FROM ({_best(6)}) v FULL JOIN ({_KEYS}) k USING (query_id, chunk_id)) QUALIFY rank <= 10"""


def _rag(spark, d):
    doc = F.col("doc_id")
    crawled = F.when(doc % 5 == 0, None).when(doc % 5 == 1, 0).otherwise(1_700_000_000 + doc * 3600)
    url = F.when(doc % 13 == 0, "").otherwise(F.concat("source", F.lit("/"), (doc % 7).cast("string")))
    vectors = t.table(spark, d, "embeddings")
    rows = t.table(spark, d, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(doc.alias("chunk_id"), F.col("source").alias("source_id"), url.alias("url"), doc.alias("chunk_number"), F.col("text").alias("content"), crawled.alias("crawled_at"), "embedding")
    vec = F.col("vec_id")
    source = F.when(vec % 150 == 0, F.concat(F.lit(" src"), (vec % 4).cast("string"), F.lit(" "))).otherwise("  ")
    asked = vectors.where("vec_id % 50 = 0").select(vec.alias("query_id"), F.col("embedding").alias("query"), F.when(vec % 100 == 0, "Licensed Under").otherwise("the").alias("words"), source.alias("source"), F.expr("vec_id div 200").alias("search"))
    return asked, rows


def _pages(found):
    return found.select("query_id", "url", "source_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "n_chunks", F.sha2("content", 256).alias("content_sha256"), F.col("place").cast("bigint").alias("place"))


@_query(_paged(_best(10)))
def rag_vector(spark, d):
    return _pages(rag.rag_query(*_rag(spark, d), 10, now=float(_NOW)))


@_query(_paged(_BOTH))
def rag_hybrid(spark, d):
    return _pages(rag.rag_query(*_rag(spark, d), 10, hybrid=True, now=float(_NOW)))


@_query(f"""SELECT search, chunk_id, round(0.7 * b + 0.3 * {_DECAY}, 6) AS score FROM (SELECT search, chunk_id, max(CASE WHEN crawled_at > 0 THEN crawled_at END) AS crawled_at, CASE WHEN any_value(lists) > 1 THEN sum(1.0 / (60 + rank)) ELSE max(s) END AS b
FROM ({_best(5)}) JOIN (SELECT search, count(DISTINCT query_id) AS lists FROM ({_best(5)}) GROUP BY search) USING (search) GROUP BY search, chunk_id)""")
def multi_query_fused(spark, d):
    return rag.multi_query(*_rag(spark, d), 5, now=float(_NOW)).select("search", "chunk_id", F.round("score", 6).alias("score"))


@_query(f"SELECT search, chunk_id, round(max(s), 6) AS score FROM ({_best(5)}) GROUP BY search, chunk_id")
def multi_query_best(spark, d):
    """Without fusion: each chunk's best similarity."""
    return rag.multi_query(*_rag(spark, d), 5, fuse=False).select("search", "chunk_id", F.round("score", 6).alias("score"))


# pages ------------------------------------------------------------------------------------------


@_query()
def page_markdown(spark, d):
    """Every page as Markdown, whole and pruned (held against literal pages in tests)."""
    out = md.markdown(t.table(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.length("raw").alias("raw_chars"), F.length("fit").alias("fit_chars"), F.sha2("content", 256).alias("content_sha256"), F.size("links").alias("n_links"))


_HREF = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
_PAGE = "SELECT regexp_replace(url, '#.*$', '') AS src, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '[^/]*$', '') AS folder, html FROM pages WHERE html IS NOT NULL"


@_query(f"""SELECT src, dst, count(*) AS n FROM (SELECT src, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN h LIKE '/%' THEN root || h ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || h END AS dst
FROM (SELECT src, root, folder, regexp_replace(replace(trim(unnest({_HREF.replace("href=", "<a href=")})), '&amp;', '&'), '#.*$', '') AS h FROM ({_PAGE})) WHERE h <> '') GROUP BY src, dst""")
def page_links(spark, d):
    """Links between addresses, resolved against their pages."""
    return crawl.links(t.table(spark, d, "pages")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query()
def budgeted_crawl(spark, d):
    """Two levels from every fiftieth page with a budget of as many addresses as there are pages (held against a plain walk in tests)."""
    pages = t.table(spark, d, "pages").select("url", "html")
    visited, _ = crawl.crawl(pages, t.table(spark, d, "pages").where("page_id % 50 = 0").select("url"), t.stored, max_pages=max(1, pages.count()), max_depth=2)
    return visited.select("url", "depth", "found", F.length("content").alias("n_chars"))


# reranking --------------------------------------------------------------------------------------

_WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> ''))"


@_query(f"""SELECT query_id, chunk_id, round(v, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS place FROM (SELECT f.query_id, f.chunk_id, f.rank,
len(list_intersect({_WORDS_OF.format("q.words || ' et le und'")}, {_WORDS_OF.format("f.content")})) / 1.0 / len({_WORDS_OF.format("q.words || ' et le und'")}) AS v FROM ({_best(10)}) f JOIN ({_ASKED}) q USING (query_id))""")
def rerank_results(spark, d):
    """Each query's ten nearest chunks by the share of its words that they hold."""
    asked, rows = _rag(spark, d)
    found = rag.candidates(asked, rows, 10).join(asked.select("query_id", F.concat("words", F.lit(" et le und")).alias("query")), "query_id")
    out = rr.rerank(found.select("query_id", "query", F.col("row.chunk_id").alias("chunk_id"), F.col("row.content").alias("content"), "rank"), rr.word_overlap)
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("place").cast("bigint").alias("place"))
