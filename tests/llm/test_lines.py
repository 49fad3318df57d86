"""Lines that many pages of a host hold, whatever stands around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, quality_rules

NOTICE, BLOCK = "\n\nAccept cookies\n\n", "Top of page\nHome News About\nSign in here"


def _docs(spark):
    own = lambda i: " ".join(f"word{i}n{j}" for j in range(40))
    texts = [f"{BLOCK}\n{own(i)}{NOTICE}{own(i + 100)}" if i < 30 else own(i) for i in range(60)]
    return spark.createDataFrame([(i, x, "site") for i, x in enumerate(texts + texts[:1] * 5)], "doc_id long, text string, source string")


def test_line_dedup_counts_texts(spark):
    docs = _docs(spark)
    assert {(r["pages"], r["host_pages"]) for r in line_dedup.boilerplate(docs).collect()} == {(30, 60)}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs).collect()}
    assert all(x not in t for t in texts.values() for x in ["Accept cookies", *BLOCK.split("\n")])


def test_quality_rules_count_texts(spark):
    rows = quality_rules.apply_rules(_docs(spark), keep=["doc_id"]).select("row.doc_id", "n_frequent_lines", "kept").collect()
    assert all(r["kept"] and r["n_frequent_lines"] == (0 if 30 <= r["doc_id"] < 60 else 4) for r in rows)


def test_quality_rules_give_the_cleaned_text(spark):
    docs = _docs(spark)
    for params in ({}, {"broadcast_lines": 0}, {"max_share": 0.9, "many_docs": 30}):
        texts = {r["doc_id"]: r["text"] for r in quality_rules.apply_rules(docs, keep=["doc_id"], **params).select("row.doc_id", "text").collect()}
        assert len(texts) == 65 and all(x not in t for t in texts.values() for x in ["Accept cookies", *BLOCK.split("\n")])
        assert all(f"word{i % 60}n3" in t for i, t in texts.items() if i < 60)
    kept = quality_rules.apply_rules(docs, max_share=0.9, many_docs=31).select("row.text", F.col("text").alias("left")).collect()
    assert all(r["text"] == r["left"] for r in kept)
