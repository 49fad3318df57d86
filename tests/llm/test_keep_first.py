"""Columns of the input come back whole, whatever their names."""

from __future__ import annotations

from corpusloom.llm import jaccard_join


def test_names_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 1), (2, text + " more", "b", 2), (3, "", "c", 3), (4, None, "d", 4)], "doc_id long, text string, _key string, row int")
    out = jaccard_join.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["_key"], r["row"]) for r in out.collect()) == [(1, "a", 1), (3, "c", 3), (4, "d", 4)]
    assert jaccard_join.keep_first(docs.limit(0)).count() == 0
