"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import graph as g
from ..operators import retrieval as r
from ..sources import tables as t
from ..streaming import ingest, state

NOW = "2024-01-31 00:00:00"
_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_TOP = f"SELECT q.vec_id AS query_id, a.vec_id, a.label, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a JOIN embeddings q ON a.vec_id <> q.vec_id"


def _targets(spark, d, where: str) -> DataFrame:
    return t.table(spark, d, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@_query(f"SELECT query_id, vec_id, label, round(s, 6) AS similarity, rank FROM ({_TOP} WHERE q.vec_id = 0) WHERE rank <= 10")
def vec_topk(spark, d):
    return r.vector_top_k(_targets(spark, d, "vec_id = 0"), t.table(spark, d, "embeddings"), 10).select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@_query(f"SELECT query_id, vec_id, label, round(s, 6) AS similarity, rank FROM ({_TOP} WHERE q.vec_id = 0 AND a.label = q.label) WHERE rank <= 10")
def vec_topk_filtered(spark, d):
    rows = t.table(spark, d, "embeddings")
    own = rows.where("vec_id = 0").select(F.col("label").alias("own"))
    same = rows.join(F.broadcast(own), F.col("label") == F.col("own")).drop("own")
    return r.vector_top_k(_targets(spark, d, "vec_id = 0"), same, 10).select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _multi(spark, d) -> DataFrame:
    return r.vector_top_k(_targets(spark, d, "vec_id % 50 = 0"), t.table(spark, d, "embeddings"), 10)


@_query(f"SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def vec_topk_multi(spark, d):
    return _multi(spark, d).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@_query(f"SELECT query_id, label, count(*) AS votes FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10 GROUP BY query_id, label")
def vec_label_votes(spark, d):
    return _multi(spark, d).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))


@_query(f"SELECT vec_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, round(max(s), 6) AS similarity FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10 GROUP BY vec_id")
def rrf_fusion(spark, d):
    return r.reciprocal_rank(_multi(spark, d), "vec_id").select("vec_id", F.round("rrf", 9).alias("rrf"), F.round("similarity", 6).alias("similarity"))


@_query(f"SELECT vec_id, query_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, query_id, rank) AS k FROM ({_TOP} WHERE q.vec_id % 50 = 0) WHERE rank <= 10) WHERE k = 1")
def dedup_best(spark, d):
    return r.best_of(_multi(spark, d), "vec_id").select("vec_id", F.col("from.query_id").alias("query_id"), F.round("similarity", 6).alias("similarity"))


@_query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed under')")
def kw_ilike(spark, d):
    return r.keyword(t.table(spark, d, "documents"), "text", "Licensed under").select("doc_id", "source")


@_query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def kw_exact(spark, d):
    return r.keyword(t.table(spark, d, "documents"), "source", "src3", mode="exact").select("doc_id", "lang")


@_query(f"""WITH v AS (SELECT vec_id AS doc_id, s FROM ({_TOP} WHERE q.vec_id = 0) WHERE rank <= 26),
k AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under') ORDER BY doc_id LIMIT 26)
SELECT doc_id, round(coalesce(0.7 * s, 0) + CASE WHEN k.doc_id IS NOT NULL THEN 0.3 ELSE 0 END, 6) AS score,
CASE WHEN s IS NOT NULL AND k.doc_id IS NOT NULL THEN 'hybrid' WHEN k.doc_id IS NOT NULL THEN 'keyword' ELSE 'vector' END AS search_type
FROM v FULL JOIN k USING (doc_id) ORDER BY coalesce(0.7 * s, 0) + CASE WHEN k.doc_id IS NOT NULL THEN 0.3 ELSE 0 END DESC, doc_id LIMIT 50""")
def hybrid_search(spark, d):
    near = r.vector_top_k(_targets(spark, d, "vec_id = 0"), t.table(spark, d, "embeddings"), 26).withColumnRenamed("vec_id", "doc_id")
    hits = r.keyword(t.table(spark, d, "documents"), "text", "licensed under").orderBy("doc_id").limit(26)
    return r.hybrid(near, hits, 50, "doc_id").withColumn("score", F.round("score", 6))


@_query(f"""SELECT source, round(max(s), 6) AS similarity, count(*) AS n, sha256(string_agg(left(text, 200), chr(10) || chr(10) ORDER BY doc_id, left(text, 200))) AS content_sha256
FROM ({_TOP} WHERE q.vec_id = 0) v JOIN documents d ON v.vec_id = d.doc_id WHERE rank <= 50 GROUP BY source""")
def rag_group_by_source(spark, d):
    near = r.vector_top_k(_targets(spark, d, "vec_id = 0"), t.table(spark, d, "embeddings"), 50)
    docs = t.table(spark, d, "documents").withColumn("piece", F.left("text", F.lit(200)))
    out = r.grouped(near.join(docs, near.vec_id == docs.doc_id), "source", order="doc_id", text="piece")
    return out.select("source", F.round("similarity", 6).alias("similarity"), "n", F.sha2("content", 256).alias("content_sha256"))


_AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0"


@_query(f"SELECT event_id, round(CASE WHEN {_AGE} <= 0 THEN 1.0 ELSE greatest(pow(0.5, {_AGE} / 14), 0.1) END, 6) AS decay, round(0.7 * 0.5 + 0.3 * CASE WHEN {_AGE} <= 0 THEN 1.0 ELSE greatest(pow(0.5, {_AGE} / 14), 0.1) END, 6) AS final FROM events")
def recency_decay(spark, d):
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    decay = s.recency_decay(age)
    return t.table(spark, d, "events").select("event_id", F.round(decay, 6).alias("decay"), F.round(s.with_recency(F.lit(0.5), decay), 6).alias("final"))


_HOST, _PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)", "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@_query(f"""SELECT page_id, regexp_replace(url, '#.*$', '') AS normal, nullif(regexp_replace(lower({_HOST}), '^www\\.', ''), '') AS host,
CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE '' END AS clean,
CASE WHEN suffix(url, 'sitemap.xml') OR contains({_PATH}, 'sitemap') THEN 'sitemap' WHEN suffix(url, '.txt') THEN 'text' ELSE 'page' END AS kind,
CASE WHEN regexp_matches(lower({_PATH}), 'token|key|auth|secret|password') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/[SENSITIVE_PATH]'
ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {_PATH} || CASE WHEN contains(url, '?') THEN '?[QUERY_REDACTED]' ELSE '' END || CASE WHEN contains(url, '#') THEN '#[FRAGMENT_REDACTED]' ELSE '' END END AS logged
FROM pages""")
def url_columns(spark, d):
    u = F.col("url")
    return t.table(spark, d, "pages").select("page_id", s.normalize_url(u).alias("normal"), s.domain(u).alias("host"), s.clean_url(u).alias("clean"), s.url_kind(u).alias("kind"), s.sanitize_url(u).alias("logged"))


@_query("SELECT page_id, substr(sha256(url), 1, 8) AS first8, md5('page|' || url) AS key FROM pages")
def cache_keys(spark, d):
    return t.table(spark, d, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 8).alias("first8"), s.cache_key(F.lit("page"), F.col("url")).alias("key"))


@_query()
def point_ids(spark, d):
    return t.table(spark, d, "pages").select("page_id", s.uuid5(s.NS_URL, F.concat(F.col("url"), F.lit("_0"))).alias("point_id"))


_BARE = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _BARE = f"regexp_replace({_BARE}, '<{_tag}[^>]*>[\\s\\S]*?</{_tag}>', ' ', 'g')"
_BARE = f"trim(regexp_replace(regexp_replace({_BARE}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@_query(f"SELECT page_id, length({_BARE}) AS n_chars, sha256({_BARE}) AS text_sha256, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def html_text(spark, d):
    text = s.html_text(F.col("html"))
    return t.table(spark, d, "pages").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"), F.size(s.links(F.col("html"))).cast("bigint").alias("n_links"))


@_query("SELECT link, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY link")
def link_degree(spark, d):
    return t.table(spark, d, "pages").select("page_id", F.explode(s.links(F.col("html"))).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
b AS (SELECT url AS node, 0 AS level FROM pages WHERE page_id = 0 UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON b.node = e.src WHERE b.level < 3)
SELECT node, min(level) AS level FROM b GROUP BY node""")
def bfs_levels(spark, d):
    pages = t.table(spark, d, "pages")
    edges = pages.select(F.col("url").alias("src"), F.explode(s.links(F.col("html"))).alias("dst")).distinct()
    return g.reach(pages.where("page_id = 0").select(F.col("url").alias("node")), edges, 3)


@_query("SELECT doc_id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words FROM documents")
def section_info(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size(s.words(F.col("text"))).cast("bigint").alias("n_words"))


@_query()
def chunks(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.posexplode(s.chunks(F.col("text"), 1000)).alias("chunk_number", "content")).select("doc_id", "chunk_number", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@_query("SELECT source, count(*) AS n_docs, sum(length(text)) AS n_chars, min(doc_id) AS first_doc, CASE WHEN length(arg_min(text, doc_id)) > 200 THEN left(arg_min(text, doc_id), 200) || '...' ELSE arg_min(text, doc_id) END AS summary FROM documents GROUP BY source")
def source_stats(spark, d):
    docs = t.table(spark, d, "documents").withColumn("head", s.truncated(F.col("text"), 200))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.min("doc_id").alias("first_doc"), F.min_by("head", "doc_id").alias("summary"))


@_query("SELECT doc_id, source, 'old' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'label' AS source, 'new' AS origin FROM labels")
def upsert_by_key(spark, d):
    old = t.table(spark, d, "documents").select("doc_id", "source", F.lit("old").alias("origin"))
    new = t.table(spark, d, "labels").select("doc_id", F.lit("label").alias("source"), F.lit("new").alias("origin")).distinct()
    return t.replace_by_key(old, new, "doc_id")


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_key(spark, d):
    return t.delete_by_key(t.table(spark, d, "documents").select("doc_id", "source"), t.table(spark, d, "labels").where("toxic = 1"), "doc_id")


@_query("SELECT lang, count(*) AS n, round(avg(length(text)), 3) AS mean_chars FROM documents GROUP BY lang")
def lang_summary(spark, d):
    return t.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 3).alias("mean_chars"))


@_query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def lang_topk(spark, d):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("k", rank).where("k <= 5").drop("k")


_STOP = ", ".join(f"'{w}'" for w in s.STOP_WORDS)


@_query(f"""WITH w AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS own FROM conversations WHERE role = 'user'),
k AS (SELECT *, list_filter(own, lambda x: x NOT IN ({_STOP})) AS kept FROM w)
SELECT conv_id, turn, sha256(coalesce(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE own END, ' '), '')) AS query_sha256 FROM k""")
def query_optimize(spark, d):
    return t.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(s.optimize_query(F.col("text")), 256).alias("query_sha256"))


@_query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn, role) AS k FROM conversations WHERE role = 'user') WHERE k = 1")
def query_dedup(spark, d):
    rank = F.row_number().over(Window.partitionBy(F.lower(F.trim("text"))).orderBy("conv_id", "turn", "role"))
    return t.table(spark, d, "conversations").where("role = 'user'").withColumn("k", rank).where("k = 1").select("conv_id", "turn")


@_query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def graph_explore(spark, d):
    orders = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"))
    own = t.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    counts = own.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.sum("price").alias("total"))
    out = t.table(spark, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"), F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), F.round("total", 2).alias("total"))


@_query("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def graph_chain(spark, d):
    out = t.table(spark, d, "region").join(t.table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t.table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(t.table(spark, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey")).select("r_name", "n_name", "c_custkey", "o_orderkey")


@_query("SELECT DISTINCT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey OR l_suppkey = s_nationkey WHERE l_quantity > 49")
def graph_or_key(spark, d):
    lines = t.table(spark, d, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_suppkey")
    own = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_nationkey"))
    return g.join_any_key(lines, own, "l_suppkey", ("s_suppkey", "s_nationkey")).select("l_orderkey", "l_linenumber", "s_suppkey").distinct()


@_query("SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(string_split(p_type, ' ')) + 1), lambda i: array_to_string(list_slice(string_split(p_type, ' '), 1, i), ' '))) AS prefix FROM part) GROUP BY prefix")
def import_prefix(spark, d):
    return t.table(spark, d, "part").select(F.explode(g.prefixes(F.col("p_type"), " ")).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT o_orderkey, round((0.3 * (c.c_custkey IS NOT NULL)::INT + 0.4 * (l.l_orderkey IS NOT NULL)::INT + 0.3 * (o_totalprice > 100000)::INT) / 1.0, 6) AS confidence
FROM orders LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) l ON l_orderkey = o_orderkey""")
def check_confidence(spark, d):
    own = t.table(spark, d, "orders").join(t.table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    own = own.join(t.table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey").distinct(), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    check = lambda ok, w: F.struct(ok.alias("passed"), F.lit(w).alias("weight"))
    checks = F.array(check(F.col("c_custkey").isNotNull(), 0.3), check(F.col("l_orderkey").isNotNull(), 0.4), check(F.col("o_totalprice") > 100000, 0.3))
    return own.select("o_orderkey", F.round(g.confidence(checks), 6).alias("confidence"))


@_query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    p = lambda x, c: F.round(F.percentile("value", x), 6).alias(c)
    return t.table(spark, d, "events").groupBy("event_type").agg(p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.round(F.avg("value"), 6).alias("mean"))


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return state.windowed(t.table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream(spark, d) -> DataFrame:
    return spark.readStream.schema(t.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The windows of a stream of events: each batch's changed windows replace those before."""
    path = f"{t.shared(spark)}/windows-{uuid.uuid4().hex}"
    changed = state.windowed(_stream(spark, d), late="60 days")
    ingest.ingest(changed, f"{path}/table", f"{path}/checkpoint", mode="update").awaitTermination()
    found = ingest.current(spark, f"{path}/table", changed.schema, ["start", "event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id, event_type")
def stream_ingest(spark, d):
    """Events of a stream, replaced by user, then counted."""
    path = f"{t.shared(spark)}/ingest-{uuid.uuid4().hex}"
    stream = _stream(spark, d).select("user_id", "event_id", "event_type", "value")
    ingest.ingest(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    rows = ingest.current(spark, f"{path}/table", stream.schema, ["user_id"])
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


from . import answers, code, search, services  # noqa: E402, F401  register their queries
