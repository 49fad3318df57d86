"""Vector, keyword and hybrid search, fusion of result lists, grouping of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, recency_decay, with_recency
from . import nearest

#: Queries that a task holds against the rows that pass it; more are dealt by their id in blocks of about that many. Searches for no more than FEW scan the rows where they lie.
QUERY_BLOCK, FEW = 16_384, 1
#: Pairs of ids that are broadcast, so the rows they are taken from stay where they lie.
SENT = 500_000


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest other rows of each query (query_id, query), ties by id. Rows without an id are left out."""
    n = queries.count()
    if n <= FEW:
        pairs = _sized(rows, vector, "_size").join(F.broadcast(_sized(queries, "query", "_query_size")), F.col(id) != F.col("query_id"))
    else:
        none = F.lit(None).cast("string").alias("source")
        asked, held = queries.select("query_id", none, F.col("query").alias("v")), rows.select(F.col(id).alias("id"), none, F.col(vector).alias("v"))
        found = best_ids(nearest.candidates(asked, held, k, math.ceil(n / QUERY_BLOCK), others=True), k, id, n)
        pairs = _sized(rows, vector, "_size").join(found, id).join(_sized(queries, "query", "_query_size"), "query_id")
    near = F.coalesce(F.try_divide(dot(F.col(vector), F.col("query")), F.col("_size") * F.col("_query_size")), F.lit(0.0))
    scored = pairs.select("query_id", *rows.columns, near.alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id))
    return scored.drop(vector).withColumn("rank", rank).where(F.col("rank") <= k)


def _sized(df: DataFrame, vector: str, name: str) -> DataFrame:
    # lengths are taken once a row, not once a pair
    return df.withColumn(name, F.sqrt(dot(F.col(vector), F.col(vector))))


def best_ids(found: DataFrame, k: int, id: str, queries: int) -> DataFrame:
    """(query_id, id), each once: those of the k best of each query's candidates, which hold its k best rows. Broadcast, where that many queries have at most SENT."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))
    ids = found.withColumn("_k", first).where(F.col("_k") <= k).select("query_id", F.col("id").alias(id)).distinct()
    return F.broadcast(ids) if queries * k <= SENT else ids


def keyword(rows: DataFrame, column: str, word: str, *, mode: str = "ilike") -> DataFrame:
    """Rows whose column equals the word (exact), or holds it in any case (ilike); the word has no wild cards."""
    if mode == "exact":
        return rows.where(F.col(column) == word)
    return rows.where(F.contains(F.lower(column), F.lit(word.lower())))


def hybrid(vector: DataFrame, words: DataFrame, n: int, id: str) -> DataFrame:
    """0.7 of the similarity, 0.3 more for a keyword hit, 0.3 for a keyword hit alone; the n best."""
    both = vector.select(id, "similarity").join(words.select(id, F.lit(True).alias("hit")), id, "full_outer")
    score = F.coalesce(0.7 * F.col("similarity"), F.lit(0.0)) + F.when(F.col("hit"), 0.3).otherwise(0.0)
    kind = F.when(F.col("similarity").isNotNull() & F.col("hit"), "hybrid").when(F.col("hit"), "keyword").otherwise("vector")
    return both.select(id, score.alias("score"), kind.alias("search_type")).orderBy(F.desc("score"), id).limit(n)


def reciprocal_rank(lists: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists a key is in."""
    return lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("similarity").alias("similarity"))


def best_of(lists: DataFrame, key: str) -> DataFrame:
    """Each key's row of highest similarity; ties by list and rank."""
    return lists.groupBy(key).agg(F.max_by(F.struct("query_id", "rank"), F.struct("similarity", -F.col("query_id"), -F.col("rank"))).alias("from"), F.max("similarity").alias("similarity"))


def grouped(results: DataFrame, key: str, *, order: str, text: str) -> DataFrame:
    """One row a key: highest similarity, and its pieces in order with a blank line between."""
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return results.groupBy(key).agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(pieces, lambda x: x[text]), "\n\n").alias("content"))


def pages_of(results: DataFrame, url: str = "url") -> DataFrame:
    """One row a URL of results (url, rank, similarity, crawled_at, chunk_number, content and others).

    Other columns come from the best-ranked row; the highest similarity and the newest known crawl time (null and 0 are
    none) count; whole pieces are put together in order, with a blank line between.
    """
    kept = {url, "rank", "similarity", "crawled_at", "chunk_number", "content"}
    others = [c for c in results.columns if c not in kept]
    pieces = F.array_sort(F.collect_list(F.struct("chunk_number", "rank", "content")))
    out = results.groupBy(url).agg(
        F.min_by(F.struct("rank", *others), F.struct("rank", "chunk_number")).alias("first"),
        F.max("similarity").alias("similarity"),
        F.max(F.when(F.col("crawled_at") > 0, F.col("crawled_at"))).alias("crawled_at"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(pieces, lambda x: x["content"]), "\n\n").alias("content"),
    )
    return out.select(url, "first.*", "similarity", "crawled_at", "n_chunks", "content")


def recent_first(results: DataFrame, now: float, *, by: str, similarity: str = "similarity", crawled_at: str = "crawled_at", weight: float = 0.3, half_life: float = 14.0, least: float = 0.1, tie: str = "url") -> DataFrame:
    """Results with `decay`, `score` ((1 - weight) similarity + weight decay) and their new `place`, within each `by`."""
    age = (F.lit(now) - F.col(crawled_at)) / 86400
    decay = recency_decay(age, half_life, least)
    out = results.withColumn("decay", decay).withColumn("score", with_recency(F.col(similarity), F.col("decay"), weight))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie)))


def multi_query(lists: DataFrame, key: str, *, fuse: bool = True) -> DataFrame:
    """One row a key of several queries' results: reciprocal ranks added up, or the best similarity, as `score`."""
    out = reciprocal_rank(lists, key)
    return out.withColumn("score", F.col("rrf") if fuse else F.col("similarity"))


def combined_top(candidates: DataFrame, n: int, *, similarity: str = "similarity", confidence: str = "confidence", weight: float = 0.6, tie: str = "vec_id") -> DataFrame:
    """The n best of each query_id's candidates by similarity and confidence together."""
    score = (1 - weight) * F.col(similarity) + weight * F.col(confidence)
    out = candidates.withColumn("combined", score)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), tie))).where(F.col("place") <= n)


def sane(rows: DataFrame, content: str = "content", place: str = "chunk_number") -> DataFrame:
    """Rows with some content and a known place."""
    return rows.where((F.length(F.btrim(content)) > 0) & F.col(place).isNotNull())
