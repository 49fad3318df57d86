"""Reranking by injected scorers."""

from __future__ import annotations

from corpusloom.operators import rerank as rr


def test_orders(spark):
    # made here, so that it is sent to workers, which have no tests
    def odd_scorer():
        return lambda queries, contents: [{"a": 1.0, "b": None, "c": float("nan"), "d": 2.0}.get(c, 0.0) for c in contents]

    rows = [(1, "q", c, i) for i, c in enumerate(["b", "a", "d", "c", "z", None, "a"])] + [(2, None, "a", 0)]
    results = spark.createDataFrame(rows, "query_id int, query string, content string, rank int")
    places = lambda df: {r["rank"]: r["place"] for r in df.where("query_id = 1").collect()}
    # two, then one twice by rank, then zero, then what has no score by rank
    assert places(rr.rerank(results, odd_scorer)) == {2: 1, 1: 2, 6: 3, 4: 4, 0: 5, 3: 6, 5: 7}
    assert places(rr.rerank(results, None)) == {i: i + 1 for i in range(7)}
    assert rr.rerank(results.limit(0), odd_scorer).count() == 0
    assert rr.rerank(results, rr.word_overlap).where("query_id = 2").first()["rerank_score"] is None


def test_urls(spark):
    urls = spark.createDataFrame([(1, "red fox", "http://x/1", "red", "fox here"), (1, "red fox", "http://x/2", None, "red"), (1, "red fox", "http://x/3", "none", None)], "query_id int, query string, url string, title string, snippet string")
    got = rr.ranked_urls(urls, rr.word_overlap, least=0.5)
    assert {(r["url"], r["score"], r["place"]) for r in got.collect()} == {("http://x/1", 1.0, 1), ("http://x/2", 0.5, 2)}
    assert [r["place"] for r in rr.ranked_urls(urls, None, most=2).orderBy("url").collect()] == [1, 2]
