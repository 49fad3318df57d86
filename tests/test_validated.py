"""Results held against a code graph, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import validated as val

RESULTS = [
    # query, chunk, similarity, source, type, class, method, name -> confidence
    (1, 1, 0.9, "r", "class", "User", None, None, 1.0),
    (1, 2, 0.9, "r", "class", "pkg.User", None, None, 1.0),
    (1, 3, 0.9, "r", "class", "Gone", None, None, 0.3 / 0.7),
    (1, 4, 0.5, "r", "method", "User", "save", "other", 1.0),
    (1, 5, 0.9, "r", "method", "", None, "save", 1.0),
    (1, 6, 0.9, "r", "method", "Other", "save", None, 0.3 / 0.7),
    (1, 7, 0.9, "r", "function", "any", "", "load", 1.0),
    (1, 8, 0.9, "r", "function", None, None, "save", 0.3),
    (1, 9, 0.9, "r", "unknown", "User", None, None, 1.0),
    (1, 10, 0.9, "r", "class", None, None, "User", 1.0),
    (1, 11, 0.9, "x", "class", "User", None, None, 0.0),
    (1, 12, 0.9, None, None, None, None, None, 0.0),
    (2, 13, None, "r", "class", "User", None, None, 1.0),
]
SYMBOLS = [("r", "class", "User", "pkg.User", None)] * 2 + [("r", "method", "User", "pkg.User", "save"), ("r", "function", None, None, "load"), ("q", "class", "Gone", None, None), (None, "class", "User", None, None)]


@pytest.fixture(scope="module")
def given(spark):
    results = spark.createDataFrame([r[:-1] for r in RESULTS], "query_id int, chunk_id int, similarity double, source_id string, code_type string, class_name string, method_name string, name string")
    return results, spark.createDataFrame([("r",), ("r",), (None,)], "repo string"), spark.createDataFrame(SYMBOLS, "repo string, kind string, class_name string, full_class_name string, name string")


def test_confidences(given):
    rows = {r["chunk_id"]: r["validation"] for r in val.validate(*given).collect()}
    assert {k: round(v["confidence"], 6) for k, v in rows.items()} == {r[1]: round(r[-1], 6) for r in RESULTS}
    assert [c["check"] for c in rows[4]["checks"]] == ["repository_exists", "method_exists", "signature_valid"]
    assert [(c["check"], c["passed"]) for c in rows[3]["checks"]] == [("repository_exists", True), ("class_exists", False)]
    assert rows[3]["suggestions"] == ["Class 'Gone' not found. Check class name spelling or repository parsing completeness."]
    assert len(rows[11]["suggestions"]) == 2 and rows[1]["suggestions"] == [] and not rows[8]["is_valid"]


def test_modes(given):
    results, repos, symbols = given
    found = val.validate(results, repos, symbols)
    places = lambda df: [r["chunk_id"] for r in df.where("query_id = 1").orderBy("place").collect()]
    assert places(val.ranked(found, 3)) == [1, 2, 5]
    assert places(val.ranked(found, mode="thorough")) == [1, 2, 5, 7, 9, 10, 4]
    assert places(val.ranked(found, mode="fast", least=0.2)) == [1, 2, 5, 7, 9, 10, 4, 3, 6]
    queries = results.select("query_id").union(results.select((F.col("query_id") + 5).alias("query_id")))
    rows = {r["query_id"]: r for r in val.search_summary(queries, found, val.ranked(found)).collect()}
    assert (rows[1]["total_found"], rows[1]["final_count"], rows[1]["high_confidence_rate"], rows[6]["total_found"], rows[6]["validation_rate"]) == (12, 7, 1.0, 0, 0.0)


def test_without_a_graph(given):
    results, repos, symbols = given
    rows = val.validate(results, repos, None).select("validation.*").distinct().collect()
    assert [(r["is_valid"], r["confidence"], r["validated"]) for r in rows] == [(True, 0.5, False)]
    assert val.validate(results.limit(0), repos, symbols).count() == 0
    assert val.validate(results, repos.limit(0), symbols.limit(0)).where("validation.confidence > 0").count() == 0


def test_doubts(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.6), ("b", 0.7), ("b", 0.1), ("c", None), ("c", 0.4)], "name string, confidence double")
    assert {tuple(r) for r in val.doubtful_by_examples(rows, "name").select("name", F.round("confidence", 6), "examples_found", "severity").collect()} == {("a", 0.4, 2, "medium"), ("c", 0.2, 2, "high")}
    assert sorted((r["name"], r["confidence"], r["severity"]) for r in val.doubtful(rows).collect()) == [("a", 0.2, "high"), ("b", 0.1, "high"), ("c", 0.0, "high"), ("c", 0.4, "medium")]
