"""The vector index against the exact search, and the keyword index against a scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keyword_index as kw
from corpusloom.operators import retrieval as r
from corpusloom.operators import vector_index as vi
from corpusloom.sources.tables import stored


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_all_rows(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vi.build(rows, stored)
    assert index.rows.count() == rows.count()
    found = lambda df: {(x["query_id"], x["vec_id"]) for x in df.select("query_id", "vec_id").collect()}
    exact = found(r.vector_top_k(asked, rows, 10))
    near = found(vi.search(index, asked, 10))
    assert len(near & exact) / len(exact) >= 0.9
    assert found(vi.search(index, asked, 10, probes=len(index.centres))) == exact


def test_well_parted_vectors_probe_few_cells(spark):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = spark.createDataFrame([(i, [x + rng.gauss(0, 0.02) for x in middles[i % 20]]) for i in range(800)], "vec_id long, embedding array<double>")
    centres, probes = vi.fit(rows)
    assert len(centres) == 28 and probes <= 4


def test_hot_cells_are_cut_and_odd_vectors_found(spark, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 10)
    rng = random.Random(1)
    vectors = [[1.0, 0.0, 0.0]] * 60 + [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)] + [None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    index = vi.build(rows, stored)
    assert max(index.parts) >= 6
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (500, [0.0, 1.0, 1.0])], "query_id long, query array<double>")
    exact = {(x["query_id"], x["rank"]): x["vec_id"] for x in r.vector_top_k(asked, rows.where("vec_id < 120"), 15).collect()}
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in vi.search(index, asked, 15, probes=len(index.centres)).where("vec_id < 120").collect()}
    assert got == exact and [got[0, i] for i in range(1, 16)] == list(range(1, 16))
    empty = vi.build(rows.limit(0), stored)
    assert vi.search(empty, asked, 5).count() == 0


def test_keywords_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(kw, "BLOCK_IDS", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcé .\n", k=rng.choice([0, 2, 5, 40, 300]))) for _ in range(200)] + [None, "", "ab", "ABC", "100% \\d .*", "x\ny", "x\ny"]
    docs = spark.createDataFrame([(3 * i, x, "n") for i, x in enumerate(texts)] + [(0, "twice abc", "n")], "doc_id long, text string, id string")
    words = ["abc", "ABC", "a", "", "é", "cé ", "%", ".*", "\\d", "x\ny", None, "abcabcabc", "a\nb", "twice abc", "zzz", "bc" * 3]
    got = {(x["keyword"], x["doc_id"]) for x in kw.search(kw.build(docs, stored), docs, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == {(w, i) for w in words if w is not None for i, x in rows if x is not None and w.lower() in x.lower()}


def test_postings_are_made_where_the_texts_lie(spark, monkeypatch):
    """Texts are neither shuffled nor collected by trigram: a block holds few characters, and rows of one id may lie in several."""
    monkeypatch.setattr(kw, "BLOCK_CHARS", 30)
    plans = {}

    def work(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    docs = spark.createDataFrame([(i, f"Ab{i} 𝒳yz é") for i in range(40)] + [(7, "other ab7 text"), (99, "q" * 500), (None, "Ab1 "), (100, None)], "doc_id long, text string")
    index = kw.build(docs, work)
    assert "Exchange" not in plans["postings"] and "Aggregate" not in plans["postings"]
    rows = index.postings.collect()
    assert len({(r.gram, r.block) for r in rows}) == len(rows) and max(len(r.ids) for r in rows) <= 4
    assert {r.gram for r in rows if 99 in r.ids} == {"qqq"} and any(r.gram == " 𝒳y" for r in rows)
    got = {(r.keyword, r.doc_id) for r in kw.search(index, docs, spark.createDataFrame([("AB7 ",), ("𝒳YZ É",), ("b39",), ("ab7 text",), ("qqqqq",), ("É",), ("zz",)], "keyword string")).collect()}
    every = {(w, i) for w in ("𝒳YZ É", "É") for i in range(40)}
    assert got == every | {("AB7 ", 7), ("b39", 39), ("ab7 text", 7), ("qqqqq", 99)}
