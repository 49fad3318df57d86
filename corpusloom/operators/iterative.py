"""Iterative search: a table of questions, each asked, judged, looked up elsewhere and asked again until it is answered.

Every open question is a row of a state table. A round moves all of them one step, and those that are done leave. Judging,
finding, fetching and rewording are given as functions from DataFrames to DataFrames, so a model, a scorer of `rerank`
or plain columns do alike. The driver holds a round's number and how many questions are open, nothing that grows.

What a round stores is seen by all questions. An address that several questions choose in one round is fetched once and counts for each.
Questions without a row from the judge have a score of 0 and no gaps; one whose score is null has failed and leaves with
status `error` and what it had. A question without words finds nothing. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .overlap import most_words
from .retrieval import QUERY_BLOCK

Step = Callable[[DataFrame], DataFrame]
Against = Callable[[DataFrame, DataFrame], DataFrame]
Store = Callable[[DataFrame, str], DataFrame]
_NO_GAPS = "array<string>"
_HISTORY = ["query_id", "iteration", "action", "query", "completeness", "gaps", "urls", "stored"]


def words(text: Column) -> Column:
    """Different words of letters and digits, in lower case, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def by_words(asked: DataFrame, rows: DataFrame, n: int = 10, *, key: str = "url", content: str = "content") -> DataFrame:
    """(query_id, rank, row): the n rows that hold most different words of each question (query_id, query), ties by key, then by a hash of the content.

    A question with several queries (rows of one query_id) takes the best of them for each row; repeated rows count once. Questions are
    sent to the tasks in blocks of about QUERY_BLOCK, and the keys of what they find are broadcast. A task counts and ranks its rows, so n rows for each
    query leave it, however many hold a common word; contents are never shuffled.
    """
    queries = asked.select("query_id", words(F.col("query")).alias("_q")).where("size(_q) > 0").withColumn("no", F.xxhash64("_q")).distinct()
    # what is asked is small, and would else be made again for each block
    lists = queries.select("query_id", "no", "_q").collect()
    keyed = rows.withColumns({"_key": F.col(key), "_hash": F.xxhash64(content)})
    held = keyed.select(F.col("_key").alias("key"), F.col("_hash").alias("hash"), words(F.col(content)).alias("words"))
    kind, spark = queries.schema["query_id"], rows.sparkSession

    def one(own: list) -> DataFrame:
        each = most_words(list({r["no"]: (r["no"], r["_q"]) for r in own}.values()), held, n)
        of = spark.createDataFrame([(r["query_id"], r["no"]) for r in own], T.StructType([kind, T.StructField("no", T.LongType())]))
        # a query's n best rows are among those of its lists
        best = first(each.groupBy("no", "key", "hash").agg(F.max("count").alias("count")), "no")
        best = first(best.drop("rank").join(F.broadcast(of), "no").groupBy("query_id", "key", "hash").agg(F.max("count").alias("count")), "query_id")
        best = best.select("query_id", "rank", F.col("key").alias("_key"), F.col("hash").alias("_hash"))
        return keyed.join(F.broadcast(best), ["_key", "_hash"]).select("query_id", "rank", F.struct(*rows.columns).alias("row")).dropDuplicates(["query_id", "rank"])

    def first(counts: DataFrame, by: str) -> DataFrame:
        return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "key", "hash"))).where(F.col("rank") <= n)

    # the lists of a query stay together
    by_query: dict = {}
    for r in lists:
        by_query.setdefault(r["query_id"], []).append(r)
    blocks: list[list] = [[]]
    for own in by_query.values():
        if len(blocks[-1]) >= QUERY_BLOCK:
            blocks.append([])
        blocks[-1] += own
    return functools.reduce(DataFrame.unionByName, [one(own) for own in blocks])


def judge_words(retrieve: Against, most: int = 5, *, content: str = "content") -> Against:
    """A judge without a model: the share of a question's words that its `most` best rows hold together; the others are its gaps."""

    def judge(asked: DataFrame, known: DataFrame) -> DataFrame:
        found = retrieve(asked, known).where(F.col("rank") <= most)
        held = found.select("query_id", F.explode(words(F.col(f"row.{content}"))).alias("_w"))
        wanted = asked.select("query_id", F.posexplode(words(F.col("query"))).alias("_at", "_w"))
        met = wanted.join(held.distinct().withColumn("_met", F.lit(True)), ["query_id", "_w"], "left")
        gaps = F.array_sort(F.collect_list(F.when(F.col("_met").isNull(), F.struct("_at", "_w"))))
        return met.groupBy("query_id").agg((F.count("_met") / F.count(F.lit(1))).alias("score"), F.transform(gaps, lambda g: g["_w"]).alias("gaps"))

    return judge


def from_gaps(asked: DataFrame) -> DataFrame:
    """A rewording without a model: what is missing, by words."""
    return asked.select("query_id", F.array_join("gaps", " ").alias("query")).where("query <> ''")


def _history(rows: DataFrame, action: str, i: int, **columns) -> DataFrame:
    given = {"completeness": F.lit(None).cast("double"), "gaps": F.lit(None).cast(_NO_GAPS), "urls": F.lit(None).cast("bigint"), "stored": F.lit(None).cast("bigint")} | columns
    return rows.select("query_id", F.lit(i).alias("iteration"), F.lit(action).alias("action"), F.col("asked").alias("query"), *[c.alias(n) for n, c in given.items()])


def _judged(rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """State rows with the judge's score and gaps, and the status of those that are done."""
    found = found.select("query_id", F.col("score").cast("double").alias("_score"), F.col("gaps").cast(_NO_GAPS).alias("_gaps"), F.lit(True).alias("_there"))
    failed = F.col("_there").isNotNull() & F.col("_score").isNull()
    score = F.coalesce("_score", F.lit(0.0))
    out = rows.join(found, "query_id", "left").withColumn("status", F.when(failed, "error").when(score >= threshold, "complete"))
    out = out.withColumn("gaps", F.when(failed, F.col("gaps")).otherwise(F.coalesce("_gaps", F.array().cast(_NO_GAPS))))
    return out.withColumn("completeness", F.when(failed, F.col("completeness")).otherwise(score)).select(*rows.columns)


def _looked_up(rows: DataFrame, urls: DataFrame, known: DataFrame, fetch: Step, store: Store) -> tuple[DataFrame, DataFrame]:
    """The rows with n_urls (chosen), n_fresh (not known yet) and stored, and what was fetched."""
    chosen = store(urls.where("url IS NOT NULL").select("query_id", "url").distinct(), "chosen")
    fresh = store(chosen.join(known.select("url").distinct(), "url", "left_anti"), "fresh")
    wanted = fresh.select("url").distinct()
    # what was not asked for is not stored
    got = store(fetch(wanted).join(wanted, "url", "left_semi").select(known.columns), "fetched")
    stored = fresh.join(got.select("url").distinct().withColumn("_got", F.lit(1)), "url", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_fresh"), F.count("_got").alias("stored"))
    counted = rows.join(chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_urls")), "query_id", "left").join(stored, "query_id", "left")
    return counted.fillna(0, ["n_urls", "n_fresh", "stored"]), got


def _finished(done: list[DataFrame], left: DataFrame, store: Store) -> DataFrame:
    rest = left.withColumn("status", F.coalesce("status", F.lit("max_iterations")))
    every = functools.reduce(DataFrame.unionByName, [*done, rest])
    return store(every.select("query_id", "query", F.col("asked").alias("last_query"), "iterations", "completeness", "gaps", "status"), "answers")


def search(
    queries: DataFrame,
    known: DataFrame,
    store: Store,
    *,
    judge: Against,
    find: Step,
    fetch: Step,
    reword: Step = from_gaps,
    threshold: float = 0.95,
    iterations: int = 3,
    least_gain: float = 0.1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, history, known): each question (query_id, query; one row an id) asked until its score reaches `threshold`, or `iterations` times.

    judge(asked, known): (query_id, score, gaps) of (query_id, query). find(asked): (query_id, url) worth fetching, of
    (query_id, query, gaps). fetch(urls): rows with the columns of `known`. reword(asked): (query_id, query) of (query_id, original, query, gaps).
    A round judges, looks up what is not known yet, judges those again for which something was stored, and rewords those
    that gained less than `least_gain`; a rewording that is missing leaves the query. store writes a table and reads it again.
    """
    left = store(queries.select("query_id", F.col("query").cast("string").alias("query"), F.col("query").cast("string").alias("asked"), F.lit(0).alias("iterations"), F.lit(0.0).alias("completeness"), F.array().cast(_NO_GAPS).alias("gaps"), F.lit(None).cast("string").alias("status")), "questions")
    columns, done, log, i = left.columns, [], [], 0
    while i < iterations and not left.isEmpty():
        i += 1
        ask = lambda df: df.select("query_id", F.col("asked").alias("query"))
        first = store(_judged(left.withColumn("iterations", F.lit(i)), judge(ask(left), known), threshold), "judged")
        log.append(_history(first.where("status IS DISTINCT FROM 'error'"), "local_check", i, completeness=F.col("completeness"), gaps=F.col("gaps")))
        done.append(first.where("status IS NOT NULL"))
        rest = first.where("status IS NULL")
        looked, got = _looked_up(rest, find(rest.select("query_id", F.col("asked").alias("query"), "gaps")), known, fetch, store)
        looked = store(looked, "looked_up")
        known = known.unionByName(got)
        log += [_history(looked, "web_search", i, urls=F.col("n_urls")), _history(looked.where("n_fresh > 0"), "crawl", i, urls=F.col("n_fresh"), stored=F.col("stored"))]
        fed = looked.where("stored > 0").select(*columns, F.col("completeness").alias("_before"))
        again = store(_judged(fed, judge(ask(fed), known), threshold).unionByName(looked.where("stored = 0").select(*columns, F.col("completeness").alias("_before"))), "judged_again")
        done.append(again.where("status IS NOT NULL").select(columns))
        left = again.where("status IS NULL")
        if i < iterations:
            slow = left.where(F.col("completeness") - F.col("_before") < least_gain)
            new = reword(slow.select("query_id", F.col("query").alias("original"), F.col("asked").alias("query"), "gaps")).select("query_id", F.col("query").alias("_new"))
            left = left.join(new, "query_id", "left").withColumn("asked", F.coalesce("_new", "asked"))
        left = store(left.select(columns), "open")
    answers = _finished(done, left, store)
    history = functools.reduce(DataFrame.unionByName, log) if log else _history(left, "local_check", 0).limit(0)
    return answers, history.select(_HISTORY), known


# by topics --------------------------------------------------------------------------------------


def _each_once(lists: DataFrame) -> DataFrame:
    """The first of a question's queries (query_id, place, query) that are equal but for case and outer blanks."""
    same = Window.partitionBy("query_id", F.lower(F.btrim("query", F.lit(" \t\r\n")))).orderBy("place")
    return lists.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


def enhanced(topics: DataFrame, expand: Step) -> DataFrame:
    """(query_id, place, query): for each topic (query_id, topic_no, topic, query) its query, its variations, the broad and the specific one; each once.

    expand adds variations (array), broad and specific to its rows; null ones are left out.
    """
    own = F.concat(F.array("query"), F.coalesce("variations", F.array().cast(_NO_GAPS)), F.array("broad", "specific"))
    every = expand(topics).select("query_id", "topic_no", F.posexplode(own).alias("_at", "query")).where("query IS NOT NULL")
    return _each_once(every.select("query_id", F.struct("topic_no", "_at").alias("place"), "query"))


def gap_queries(uncovered: DataFrame, expand: Step) -> DataFrame:
    """(query_id, place, query): of each uncovered topic (query_id, topic_no, topic, query: the question) the specific query and the first variation; each once."""
    asked = uncovered.withColumn("query", F.concat_ws(" ", "query", "topic"))
    own = F.array("specific", F.get(F.coalesce("variations", F.array().cast(_NO_GAPS)), F.lit(0)))
    every = expand(asked).select("query_id", "topic_no", F.posexplode(own).alias("_at", "query")).where("query IS NOT NULL")
    return _each_once(every.select("query_id", F.struct("topic_no", "_at").alias("place"), "query"))


def topic_coverage(topics: DataFrame, lists: DataFrame, known: DataFrame, retrieve: Against, cover: Step, *, most: int = 10, covered: float = 0.8) -> DataFrame:
    """(query_id, topic_no, topic, score, covered): the best score that cover gives a topic among the question's `most` best rows; 0 without rows.

    cover adds `score` to rows of (query_id, topic_no, topic, content); null and missing scores count as 0.
    """
    rows = retrieve(lists, known).where(F.col("rank") <= most).select("query_id", F.col("row.content").alias("content"))
    pairs = topics.select("query_id", "topic_no", "topic").join(rows, "query_id")
    best = cover(pairs).groupBy("query_id", "topic_no").agg(F.max("score").alias("score"))
    out = topics.select("query_id", "topic_no", "topic").join(best, ["query_id", "topic_no"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("covered", F.col("score") >= covered)


def deep_search(
    queries: DataFrame,
    topics: DataFrame,
    known: DataFrame,
    store: Store,
    *,
    retrieve: Against,
    cover: Step,
    expand: Step,
    find: Step,
    fetch: Step,
    threshold: float = 0.95,
    iterations: int = 3,
    covered: float = 0.8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, history, coverage): questions by their topics (query_id, topic_no, topic, query); the mean of a question's topics is its score.

    After the first check a round looks up the first query for the gaps, and the second of those that find no address, and checks again the questions
    for which something was stored, with their first queries and the round's. gaps are the uncovered topics. A question without topics has no
    rows here: give it to `search`. coverage is of each question's last check.
    """
    topics = store(topics.select("query_id", "topic_no", "topic", "query"), "topics")
    lists = store(enhanced(topics, expand), "queries")
    asked = queries.select("query_id", F.col("query").cast("string").alias("query")).join(topics.select("query_id").distinct(), "query_id", "left_semi")

    def checked(rows: DataFrame, lists: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
        own = topics.join(rows.select("query_id"), "query_id", "left_semi")
        found = store(topic_coverage(own, lists.join(rows.select("query_id"), "query_id", "left_semi"), known, retrieve, cover, covered=covered), "coverage")
        missing = F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("topic_no", "topic"))))
        per = found.groupBy("query_id").agg(F.avg("score").alias("score"), F.transform(missing, lambda m: m["topic"]).alias("gaps"))
        return store(_judged(rows.withColumn("iterations", F.lit(i)), per, threshold), "judged"), found.withColumn("iteration", F.lit(i))

    left = asked.select("query_id", "query", F.col("query").alias("asked"), F.lit(0).alias("iterations"), F.lit(0.0).alias("completeness"), F.array().cast(_NO_GAPS).alias("gaps"), F.lit(None).cast("string").alias("status"))
    columns, i = left.columns, 1
    left, found = checked(left, lists, i)
    done, log, coverage = [left.where("status IS NOT NULL")], [_history(left, "local_check", 1, completeness=F.col("completeness"), gaps=F.col("gaps"))], [found]
    left = store(left.where("status IS NULL"), "open")
    while i < iterations and not left.isEmpty():
        i += 1
        named = left.withColumn("iterations", F.lit(i)).select("*", F.posexplode_outer("gaps").alias("_no", "_topic"))
        uncovered = named.where("_topic IS NOT NULL").select("query_id", F.col("_no").alias("topic_no"), F.col("_topic").alias("topic"), "query")
        own = uncovered.where("topic_no < 3").select("query_id", F.struct((F.col("topic_no") + 1_000_000).alias("topic_no"), F.lit(0).alias("_at")).alias("place"), F.concat_ws(" ", "query", "topic").alias("query"))
        # the judge's own queries come after those of the topics, and are not compared with them
        gaps = store(gap_queries(uncovered, expand).select("query_id", "place", "query").unionByName(own), "gaps")
        ranked = gaps.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
        turn = lambda k: left.select("query_id", F.col("query").alias("_own"), "gaps").join(ranked.where(F.col("_k") == k).select("query_id", F.col("query").alias("_gap")), "query_id", "left")
        one = store(find(turn(1).select("query_id", F.coalesce("_gap", "_own").alias("query"), "gaps")).select("query_id", "url"), "urls")
        two = find(turn(2).where("_gap IS NOT NULL").join(one.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("_gap").alias("query"), "gaps")).select("query_id", "url")
        looked, got = _looked_up(left.withColumn("iterations", F.lit(i)), one.unionByName(two), known, fetch, store)
        looked = store(looked, "looked_up")
        known = known.unionByName(got)
        log += [_history(looked, "web_search", i, urls=F.col("n_urls")), _history(looked.where("n_fresh > 0"), "crawl", i, urls=F.col("n_fresh"), stored=F.col("stored"))]
        fed = looked.where("stored > 0").select(columns)
        again, found = checked(fed, lists.select("query_id", "query").unionByName(gaps.select("query_id", "query")), i)
        coverage.append(found)
        done.append(again.where("status IS NOT NULL"))
        left = store(again.where("status IS NULL").unionByName(looked.where("stored = 0").select(columns)), "open")
    every = functools.reduce(DataFrame.unionByName, coverage)
    last = every.withColumn("_last", F.max("iteration").over(Window.partitionBy("query_id"))).where("iteration = _last").drop("_last")
    return _finished(done, left, store), functools.reduce(DataFrame.unionByName, log).select(_HISTORY), last
