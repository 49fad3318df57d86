"""The iterative search and the search by topics against plain loops."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import iterative as it
from corpusloom.operators import overlap
from corpusloom.operators import rerank as rr
from corpusloom.sources import tables as t

QUESTIONS = {1: "red fox jumps", 2: "blue whale sings loud songs", 3: "", 4: None, 5: "no such thing", 6: "red whale", 7: "fails here", 8: "fox"}
KNOWN = {"k/1": "a red thing", "k/2": "the whale is blue", "k/3": None, "k/4": "fox fox fox", "k/5": "fails"}
# addresses that a word leads to, and what is there; w/4 can't be fetched
LINKS = [("fox", "w/1"), ("red", "w/1"), ("loud", "w/2"), ("songs", "w/3"), ("sings", "w/3"), ("such", "w/4"), ("whale", "k/2"), ("jumps", "w/5"), ("thing", None), ("no", "w/6")]
WEB = {"w/1": "red fox here", "w/2": "LOUD, loud!", "w/3": "", "w/5": "it jumps", "w/6": "such a day"}


def _words(text):
    return list(dict.fromkeys(w for w in re.split(r"[^\w]+", (text or "").lower()) if w))


def _best(queries, rows, n):
    """Addresses of the n rows that hold most words of the best of the queries."""
    held = {u: max(len(set(_words(c)) & set(_words(q))) for q in queries) for u, c in rows.items()} if queries else {}
    return sorted((u for u, k in held.items() if k), key=lambda u: (-held[u], u))[:n]


def _judge(query, rows, most):
    held = {w for u in _best([query], rows, most) for w in _words(rows[u])}
    asked = _words(query)
    return (sum(w in held for w in asked) / len(asked), [w for w in asked if w not in held]) if asked else (0.0, [])


def _fetched(urls, rows):
    fresh = {u for u in urls if u not in rows}
    return fresh, {u: WEB[u] for u in fresh if u in WEB}


def _plain(threshold, iterations, least_gain):
    rows, log, out = dict(KNOWN), [], {}
    left = {i: {"query": q, "asked": q} for i, q in QUESTIONS.items()}
    for n in range(1, iterations + 1):
        chosen = {}
        for i, s in list(left.items()):
            s["n"], failed = n, i == 7
            if failed:
                out[i] = (s["asked"], n, s.get("score", 0.0), tuple(s.get("gaps", [])), "error")
                del left[i]
                continue
            s["score"], s["gaps"] = _judge(s["asked"], rows, 2)
            log.append((i, n, "local_check", s["asked"], round(s["score"], 6), None, None))
            if s["score"] >= threshold:
                out[i] = (s["asked"], n, round(s["score"], 6), tuple(s["gaps"]), "complete")
                del left[i]
                continue
            chosen[i] = {u for w, u in LINKS if u and w in _words(s["asked"])}
        fresh = {i: _fetched(urls, rows) for i, urls in chosen.items()}
        for _, got in fresh.values():
            rows.update(got)
        for i, s in list(left.items()):
            log.append((i, n, "web_search", s["asked"], None, len(chosen[i]), None))
            if fresh[i][0]:
                log.append((i, n, "crawl", s["asked"], None, len(fresh[i][0]), len(fresh[i][1])))
            before = s["score"]
            if fresh[i][1]:
                s["score"], s["gaps"] = _judge(s["asked"], rows, 2)
                if s["score"] >= threshold:
                    out[i] = (s["asked"], n, round(s["score"], 6), tuple(s["gaps"]), "complete")
                    del left[i]
                    continue
            if n < iterations and s["score"] - before < least_gain:
                s["asked"] = " ".join(s["gaps"]) or s["asked"]
    for i, s in left.items():
        out[i] = (s["asked"], s["n"], round(s["score"], 6), tuple(s["gaps"]), "max_iterations")
    return out, sorted(log, key=str), rows


@pytest.fixture(scope="module")
def given(spark):
    table = lambda rows: spark.createDataFrame(list(rows.items()), "url string, content string")
    queries = spark.createDataFrame(list(QUESTIONS.items()), "query_id int, query string")
    links = spark.createDataFrame(LINKS, "_w string, url string")
    web = table(WEB)
    find = lambda asked: asked.select("query_id", F.explode(it.words(F.col("query"))).alias("_w")).join(links, "_w").select("query_id", "url")
    # w/1 comes twice, and something that nobody asked for
    fetch = lambda urls: web.unionByName(web.where("url = 'w/1'"))
    return queries, table(KNOWN), find, fetch


@pytest.mark.parametrize(("iterations", "threshold", "least_gain"), [(3, 0.95, 0.1), (2, 0.6, 0.9)])
def test_loop(given, iterations, threshold, least_gain):
    queries, known, find, fetch = given
    by_words = it.judge_words(it.by_words, 2)
    judge = lambda asked, rows: by_words(asked, rows).withColumn("score", F.when(F.col("query_id") != 7, F.col("score")))
    answers, history, rows = it.search(queries, known, t.stored, judge=judge, find=find, fetch=fetch, threshold=threshold, iterations=iterations, least_gain=least_gain)
    want, log, stored = _plain(threshold, iterations, least_gain)
    assert {r["query_id"]: (r["last_query"], r["iterations"], round(r["completeness"], 6), tuple(r["gaps"]), r["status"]) for r in answers.collect()} == want
    got = [(r["query_id"], r["iteration"], r["action"], r["query"], None if r["completeness"] is None else round(r["completeness"], 6), r["urls"], r["stored"]) for r in history.collect()]
    assert sorted(got, key=str) == log
    assert {r["url"] for r in rows.collect()} == set(stored)
    assert {r["query_id"]: r["query"] for r in answers.collect()} == QUESTIONS


def test_empty(given):
    queries, known, find, fetch = given
    judge = it.judge_words(it.by_words)
    answers, history, rows = it.search(queries.limit(0), known, t.stored, judge=judge, find=find, fetch=fetch)
    assert (answers.count(), history.count(), rows.count()) == (0, 0, len(KNOWN))
    answers, _, _ = it.search(queries, known.limit(0), t.stored, judge=judge, find=lambda a: a.select("query_id", F.lit(None).cast("string").alias("url")), fetch=fetch, iterations=1)
    assert {(r["completeness"], r["status"]) for r in answers.collect()} == {(0.0, "max_iterations")}


def test_by_words_takes_repeated_rows_once(spark):
    rows = spark.createDataFrame([("u", "a b"), ("u", "a b"), ("u", "a"), ("v", "b a c")], "url string, content string")
    asked = spark.createDataFrame([(1, "A b"), (1, "c"), (2, "!"), (2, None)], "query_id int, query string")
    found = it.by_words(asked, rows).select("query_id", "rank", "row.url", "row.content").collect()
    assert sorted(map(tuple, found)) == [(1, 1, "u", "a b"), (1, 2, "v", "b a c"), (1, 3, "u", "a")]


TOPICS = {1: ["red fox", "jumps high"], 2: ["blue whale", "loud songs"], 5: ["no"], 8: ["fox"]}


def _expand(query):
    return query.split()[:1], query.split()[-1], query + " such"


def _once(queries):
    return list({q.lower().strip(): q for q in reversed(queries)}.values())[::-1]


def _plain_deep(threshold, iterations, covered):
    rows, out = dict(KNOWN), {}
    first = {i: _once([q for x in topics for v, broad, specific in [_expand(x)] for q in (x, *v, broad, specific)]) for i, topics in TOPICS.items()}

    def check(i, queries):
        best = [rows[u] for u in _best(queries, rows, 10)]
        share = lambda x: max((len(set(x.split()) & set((c or "").lower().split())) / len(set(x.split())) for c in best), default=0.0)
        scores = [share(x) for x in TOPICS[i]]
        return sum(scores) / len(scores), [x for x, s in zip(TOPICS[i], scores, strict=True) if s < covered]

    left = {i: [1, *check(i, first[i])] for i in TOPICS}
    for n in range(1, iterations + 1):
        if n > 1:
            chosen, gaps = {}, {}
            for i, (_, _, open_) in left.items():
                asked = [f"{QUESTIONS[i]} {x}" for x in open_]
                gaps[i] = _once([q for x in asked for v, _, specific in [_expand(x)] for q in (specific, *v[:1])]) + asked[:3]
                for q in (gaps[i] or [QUESTIONS[i]])[:2]:
                    chosen[i] = {u for w, u in LINKS if u and w in _words(q)}
                    if chosen[i]:
                        break
            fresh = {i: _fetched(urls, rows) for i, urls in chosen.items()}
            for _, got in fresh.values():
                rows.update(got)
            left = {i: [n, *(check(i, first[i] + gaps[i]) if fresh[i][1] else s[1:])] for i, s in left.items()}
        for i, s in list(left.items()):
            if s[1] >= threshold:
                out[i] = (s[0], round(s[1], 6), tuple(s[2]), "complete")
                del left[i]
    return out | {i: (s[0], round(s[1], 6), tuple(s[2]), "max_iterations") for i, s in left.items()}


def test_topics(given, spark):
    queries, known, find, fetch = given
    topics = spark.createDataFrame([(i, n, x, x) for i, xs in TOPICS.items() for n, x in enumerate(xs)], "query_id int, topic_no int, topic string, query string")
    parts = F.split("query", " ")
    expand = lambda rows: rows.withColumns({"variations": F.array(parts[0]), "broad": F.get(parts, F.size(parts) - 1), "specific": F.concat("query", F.lit(" such"))})
    cover = lambda pairs: rr.scored(pairs, rr.word_overlap, query="topic", into="score")
    answers, history, coverage = it.deep_search(queries, topics, known, t.stored, retrieve=it.by_words, cover=cover, expand=expand, find=find, fetch=fetch)
    want = _plain_deep(0.95, 3, 0.8)
    assert {r["query_id"]: (r["iterations"], round(r["completeness"], 6), tuple(r["gaps"]), r["status"]) for r in answers.collect()} == want
    assert {(r["query_id"], r["topic"]) for r in coverage.where("NOT covered").collect()} == {(i, x) for i, w in want.items() for x in w[2]}
    assert history.where("action = 'local_check'").count() == len(TOPICS)
    lists = it.enhanced(topics.where("query_id = 8"), expand).collect()
    assert {r["query"] for r in lists} == {"fox", "fox such"}


def test_best_rows_equal_a_plain_count(monkeypatch):
    rng = random.Random(5)
    lists = [rng.sample("abcdefgh", rng.randint(1, 6)) for _ in range(30)] + [["none"]]
    rows = [(rng.choice([None, *"klmnop"]), rng.randint(-3, 3), rng.sample("abcdefxyz", rng.randint(0, 9))) for _ in range(400)]
    # a key and hash stand for one content
    rows = list({(k, h): (k, h, w) for k, h, w in rows}.values()) * 3
    rng.shuffle(rows)
    want = {}
    for j, own in enumerate(lists):
        found = {((k is not None, k, h), len(set(own) & set(w))) for k, h, w in rows}
        want[j] = sorted(((-c, r) for r, c in found if c), key=lambda x: x)[:4]
    for counts in (1, 500, 1 << 20):
        monkeypatch.setattr(overlap, "COUNTS", counts)
        best = overlap._Best(lists, 4)
        for a in range(0, len(rows), 37):
            part = rows[a : a + 37]
            best.add([r[0] for r in part], [r[1] for r in part], pa.array([r[2] for r in part], pa.list_(pa.string())))
        kept, found = best.best()
        got = {j: sorted((-c, found[i]) for x, c, i in kept.tolist() if x == j) for j in range(len(lists))}
        assert got == want


def test_few_rows_leave_the_tasks(spark):
    """However many rows hold a common word, a task gives on no more than n for each different list of words."""
    rows = spark.range(0, 5000, 1, 4).selectExpr("concat('u', id) AS url", "concat('common ', id % 7) AS content")
    asked = spark.createDataFrame([(1, "common"), (2, "Common 3"), (2, "common"), (3, "no"), (4, "3 common")], "query_id int, query string")
    lists = [(i, w) for i, w in enumerate((["common"], ["common", "3"], ["no"]))]
    held = rows.select(F.col("url").alias("key"), F.xxhash64("content").alias("hash"), it.words(F.col("content")).alias("words"))
    assert overlap.most_words(lists, held, 10).groupBy("no").count().where("count > 40").count() == 0
    found = sorted((r["query_id"], r["rank"], r["url"]) for r in it.by_words(asked, rows).select("query_id", "rank", "row.url").collect())
    plain, three = sorted(f"u{i}" for i in range(5000))[:10], sorted(f"u{i}" for i in range(5000) if i % 7 == 3)[:10]
    assert found == [(q, k + 1, u) for q, urls in ((1, plain), (2, three), (4, three)) for k, u in enumerate(urls)]
