"""Languages of results, and summaries by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import languages as ln


def test_language(spark):
    rows = [
        ("http://a.com/x/b.py", None, None, "python", "python"), ("http://a.com/b.JSON", None, None, "unknown", "javascript"), ("http://a.com", None, None, "unknown", "c"), ("a/b.test.tsx?x=.go#y", None, None, "typescript", "typescript"),
        ("b.py", "Ruby", "js", "ruby", "ruby"), ("b.py", "", "KT", "kotlin", "kotlin"), ("b.py", None, "zig", "zig", "zig"), (None, None, None, "unknown", "unknown"), ("", None, "", "unknown", "unknown"), (".py", None, None, "unknown", "python"),
    ]
    table = spark.createDataFrame(rows, "url string, named string, ext string, want string, loose string")
    got = table.select("want", "loose", ln.language(F.col("url"), F.col("named"), F.col("ext")).alias("a"), ln.language(F.col("url"), F.col("named"), F.col("ext"), anywhere=True).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(r["want"], r["loose"]) for r in got]


def test_across(spark):
    found = spark.createDataFrame([(1, 1, "go", 0.5), (1, 2, "go", 0.9), (1, 3, "go", None), (1, 4, "c", 0.2), (1, 5, "c", 0.2), (2, 6, "rust", 0.1)], "query_id int, chunk_id int, language string, similarity double")
    top = ln.across(found, 2)
    assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in top.collect()) == [(1, 1, 2), (1, 2, 1), (1, 4, 1), (1, 5, 2), (2, 6, 1)]
    rows = {r["query_id"]: r for r in ln.across_summary(top).collect()}
    assert (rows[1]["total"], rows[1]["languages"], rows[1]["most_relevant"], rows[1]["mean"]) == (4, ["c", "go"], "c", {"c": 0.2, "go": 0.7})
    assert {r["language"] for r in ln.across(found, languages=["GO"]).collect()} == {"go"}
    assert ln.across_summary(ln.across(found.limit(0))).count() == 0


def test_by_signature(spark):
    examples = spark.createDataFrame([(1, "f", "A", "r"), (2, "f", None, "s"), (3, "g", "A", "r"), (4, "f", "B", "r"), (5, None, "A", "r")], "chunk_id int, name string, class_name string, repo string")
    asked = spark.createDataFrame([(1, "f", None, None), (2, "f", "A", ""), (3, "f", "", "s"), (4, None, "A", "r")], "query_id int, name string, class_name string, repo string")
    got = ln.by_signature(examples, asked, 2).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in got) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 2, 1)]
