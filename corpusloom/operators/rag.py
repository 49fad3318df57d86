"""The composed search: vector or hybrid candidates of each query, within its source, by page, weighed by age."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, recency_decay, with_recency
from . import nearest
from .retrieval import QUERY_BLOCK, best_ids

#: Different searches for words that are broadcast against all texts at a time.
WORDS_BLOCK = 1000


def source_of(source: Column) -> Column:
    """A query's source, trimmed; null, which means any, where it is blank."""
    return F.nullif(F.btrim(source, F.lit(" \t\n\r")), F.lit(""))


def _near(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The n nearest rows of each query in its source, as (query_id, row, s, k): ids first, of all queries at once; only rows that are found are read whole."""
    asked = queries.select("query_id", "query", source_of(F.col("source")).alias("_source"))
    count = asked.count()
    blocks = max(1, math.ceil(count / QUERY_BLOCK))
    held = rows.select(F.col("chunk_id").alias("id"), F.col("source_id").alias("source"), F.col("embedding").alias("v"))
    found = best_ids(nearest.candidates(asked.select("query_id", F.col("_source").alias("source"), F.col("query").alias("v")), held, n, blocks, others=False), n, "chunk_id", count)
    size = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    inside = F.col("_source").isNull() | (F.col("_source") == F.col("source_id"))
    pairs = rows.join(found, "chunk_id").join(asked, "query_id").where(inside)
    near = F.coalesce(F.try_divide(dot(F.col("embedding"), F.col("query")), size("embedding") * size("query")), F.lit(0.0))
    return _first(pairs.select("query_id", _row(rows), near.alias("s")), [F.desc("s"), "row.chunk_id"], n)


def _row(rows: DataFrame) -> Column:
    return F.struct(*[c for c in rows.columns if c != "embedding"]).alias("row")


def _first(pairs: DataFrame, order: list, n: int) -> DataFrame:
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("k") <= n)


def _holding(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by chunk_id of each query in its source that hold its words, as (query_id, row, k). Texts are looked at once for each different search, not once a query."""
    asked = queries.select("query_id", F.lower("words").alias("words"), source_of(F.col("source")).alias("_source"))
    searches = asked.select("words", "_source").distinct()
    blocks = max(1, math.ceil(searches.count() / WORDS_BLOCK))
    block = F.pmod(F.xxhash64("words", "_source"), F.lit(blocks))
    inside = F.col("_source").isNull() | (F.col("_source") == F.col("source_id"))
    texts = rows.where("chunk_id IS NOT NULL").select("chunk_id", "source_id", F.lower("content").alias("_content"))
    first = F.row_number().over(Window.partitionBy("words", "_source").orderBy("chunk_id"))
    # ids alone are ordered; rows that are found are read afterwards
    one = lambda own: texts.join(F.broadcast(own), inside & F.contains("_content", "words")).select("words", "_source", "chunk_id").withColumn("k", first).where(F.col("k") <= n)
    hits = functools.reduce(DataFrame.unionByName, [one(searches.where(block == i) if blocks > 1 else searches) for i in range(blocks)]).select("words", "_source", "chunk_id").distinct()
    named = hits.select(F.col("words").alias("_w"), F.col("_source").alias("_s"), "chunk_id")
    found = asked.join(named, (F.col("words") == F.col("_w")) & F.col("_source").eqNullSafe(F.col("_s"))).select("query_id", "chunk_id", "words", "_source").distinct()
    # of repeated ids only rows of the source that hold the words count
    pairs = rows.join(found, "chunk_id").where(inside & F.contains(F.lower("content"), "words"))
    return _first(pairs.select("query_id", _row(rows)), ["row.chunk_id"], n)


def candidates(queries: DataFrame, rows: DataFrame, n: int, *, hybrid: bool = False) -> DataFrame:
    """(query_id, row, similarity, search_type, rank): n rows of each query (query_id, query, words, source).

    rows: chunk_id, source_id, url, chunk_number, content, embedding and others. Vector: the n nearest in the query's source, ties by chunk_id.
    Hybrid: n // 2 + 1 of those, and as many whose content holds the words in any case (by chunk_id); 0.7 of the
    similarity, and 0.3 for holding the words; a blank `words` finds nothing. The best n stay.
    """
    near = _near(queries, rows, n // 2 + 1 if hybrid else n)
    if not hybrid:
        return near.select("query_id", "row", F.col("s").alias("similarity"), F.lit("vector").alias("search_type"), F.col("k").alias("rank"))
    hits = _holding(queries.where("btrim(words) <> ''"), rows, n // 2 + 1)
    both = near.select("query_id", F.col("row.chunk_id").alias("chunk_id"), "row", "s").join(hits.select("query_id", F.col("row.chunk_id").alias("chunk_id"), F.col("row").alias("hit")), ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(0.7 * F.col("s"), F.lit(0.0)) + F.when(F.col("hit").isNotNull(), 0.3).otherwise(0.0)
    kind = F.when(F.col("s").isNotNull() & F.col("hit").isNotNull(), "hybrid").when(F.col("hit").isNotNull(), "keyword").otherwise("vector")
    merged = both.select("query_id", F.coalesce("row", "hit").alias("row"), score.alias("similarity"), kind.alias("search_type"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row.chunk_id"))).where(F.col("rank") <= n)


def by_page(found: DataFrame) -> DataFrame:
    """One row a query and URL: source and title of the best-ranked chunk, the highest similarity, the newest known crawl time, all chunks in order with a blank line between. Rows without a URL go."""
    pieces = F.array_sort(F.collect_list(F.struct("row.chunk_number", "rank", "row.content")))
    title = [F.min_by("row.title", "rank").alias("title")] if "title" in found.schema["row"].dataType.names else []
    out = found.where("row.url <> ''").groupBy("query_id", F.col("row.url").alias("url")).agg(
        F.min_by("row.source_id", "rank").alias("source_id"), *title, F.max("similarity").alias("similarity"), F.max(F.when(F.col("row.crawled_at") > 0, F.col("row.crawled_at"))).alias("crawled_at"),
        F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(pieces, lambda x: x["content"]), "\n\n").alias("content"),
    )
    return out


def rag_query(queries: DataFrame, rows: DataFrame, n: int = 5, *, hybrid: bool = False, now: float | None = None, weight: float = 0.3, half_life: float = 14.0, least: float = 0.1) -> DataFrame:
    """Pages for each query in order: `candidates` by page, with `score` and `place`.

    now: a time in seconds at which age counts by `weight`; without it the score is the similarity. Ties go by URL.
    """
    pages = by_page(candidates(queries, rows, n, hybrid=hybrid))
    decay = recency_decay((F.lit(now) - F.col("crawled_at")) / 86400, half_life, least)
    scored = pages.withColumn("score", F.col("similarity") if now is None else with_recency(F.col("similarity"), decay, weight))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url")))


def multi_query(queries: DataFrame, rows: DataFrame, n: int = 5, *, fuse: bool = True, now: float | None = None, weight: float = 0.3, half_life: float = 14.0, least: float = 0.1, k: int = 60) -> DataFrame:
    """(search, chunk_id, score, place): the vector results of all queries of a search (queries: search besides the others) as one list.

    fuse and more than one query of the search that finds anything: 1 / (k + rank) summed over its lists; otherwise the best similarity a chunk
    has in one of them. Then age, as in `rag_query`; ties go by chunk_id. A search of one query keeps its similarities.
    """
    found = candidates(queries, rows, n).join(queries.select("query_id", "search"), "query_id")
    lists = found.groupBy("search").agg(F.count_distinct("query_id").alias("lists"))
    chunks = found.groupBy("search", F.col("row.chunk_id").alias("chunk_id")).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("similarity").alias("best"), F.max("row.crawled_at").alias("crawled_at"))
    base = F.when((F.col("lists") > 1) & F.lit(fuse), F.col("rrf")).otherwise(F.col("best"))
    decay = recency_decay((F.lit(now) - F.when(F.col("crawled_at") > 0, F.col("crawled_at"))) / 86400, half_life, least)
    scored = chunks.join(lists, "search").withColumn("score", base if now is None else with_recency(base, decay, weight))
    return scored.select("search", "chunk_id", "score", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "chunk_id")).alias("place"))
