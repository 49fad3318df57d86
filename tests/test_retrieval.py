"""Searches for more queries than are broadcast at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as r


def test_blocks_of_queries(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = lambda: sorted(map(tuple, r.vector_top_k(queries, rows, 10).select("query_id", "vec_id", "rank", "similarity").collect()))
    whole = found()
    monkeypatch.setattr(r, "QUERY_BLOCK", 3)
    assert queries.count() > 3 and found() == whole


def test_many_queries_without_pairs(spark):
    """Copies, ties, odd vectors and sources: as each pair for itself gives it, and no join of all pairs in the plan."""
    import random

    from corpusloom.operators import rag

    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(120)]
    vectors += [vectors[5]] * 60 + [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [1.0, 2.0]]
    data = [(i, v, f"s{i % 3}") for i, v in enumerate(vectors)] + [(7, vectors[9], "s0")]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, source_id string").repartition(3)
    queries = rows.where("vec_id % 5 = 0 OR vec_id > 178").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def pairs(match, k, id):
        sized = lambda v: F.sqrt(r.dot(F.col(v), F.col(v)))
        near = F.coalesce(F.try_divide(r.dot(F.col("embedding"), F.col("query")), sized("embedding") * sized("query")), F.lit(0.0))
        rank = F.row_number().over(r.Window.partitionBy("query_id").orderBy(F.desc("s"), id))
        return lambda q, w: sorted(map(repr, q.crossJoin(w).where(match).select("query_id", id, near.alias("s")).withColumn("rank", rank).where(F.col("rank") <= k).collect()))

    found = r.vector_top_k(queries, rows, 10)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = sorted(map(repr, found.select("query_id", "vec_id", F.col("similarity").alias("s"), "rank").collect())), pairs("vec_id <> query_id", 10, "vec_id")(queries, rows)
    assert got == want, (set(got) - set(want), set(want) - set(got))
    chunks = rows.withColumnRenamed("vec_id", "chunk_id").withColumns({"content": F.lit("x")})
    asked = queries.withColumns({"words": F.lit("x"), "source": F.when(F.col("query_id") % 2 == 0, F.concat(F.lit(" s"), (F.col("query_id") % 3).cast("string"))).otherwise(" ")})
    got = rag.candidates(asked, chunks, 7).select("query_id", "row.chunk_id", F.col("similarity").alias("s"), "rank")
    assert sorted(map(repr, got.collect())) == pairs("trim(source) = '' OR trim(source) = source_id", 7, "chunk_id")(asked, chunks)
