"""Ranked search against plain Python and its own SQL, whole and in small segments and blocks."""

from __future__ import annotations

import random

import brute
import duckdb
import pyarrow as pa
import pytest

from corpusloom.llm import queries as q
from corpusloom.llm import ranked
from corpusloom.llm.workspace import Workspace


def _made():
    rng = random.Random(3)
    words = [f"t{min(int(rng.paretovariate(0.6)), 300)}" for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 8, 8, 8, 40]))) for _ in range(300)]
    texts += ["Hot hot HOT cold"] * 90 + [None, "", " ...!?", "é É hot", "[brackets] {hot}", "x" * 70_000, "hot " * 60_000]
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "Hot hot HOT cold"), (7, "Hot hot HOT cold")]
    items = [(1, "hot cold"), (2, None), (3, "..."), (1, "hot"), (None, "t1 t2 t3 T1"), (4, "nothing-like-it"), (5, " ".join(words))]
    return docs, items


def _key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


@pytest.mark.parametrize(("segment_terms", "block_items"), [(1 << 17, 1000), (50, 2)])
def test_ranks_equal_brute_force(spark, monkeypatch, segment_terms, block_items):
    docs, items = _made()
    want = _key(brute.op11(docs, items, 20))
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", block_items)
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, m string, n int").repartition(5)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    with Workspace(spark, "t") as work:
        index = ranked.build(given, work.path("segments"), work, segment_terms=segment_terms)
        assert index.segments.count() > (30 if segment_terms == 50 else 1)
        got = _key(ranked.search(index, asked, 20, work).select("item_id", "rank", "doc_id", "score").collect())
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert got == want


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    tables = {t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))}
    got = _key(q.op11_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect())
    assert got == _key(brute.op11(tables["documents"], tables["benchmark"]))
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == _key(c.sql(q.RANKED_SQL).fetchall())


def test_empty_tables_give_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(docs, items, 5).count() == 0
    assert ranked.rank(spark.createDataFrame([(1, "a b")], docs.schema), items.limit(0), 5).count() == 0
    assert [tuple(r) for r in ranked.rank(spark.createDataFrame([(1, "a b"), (2, "b c")], docs.schema), items, 5).collect()] == [(1, 1, 1, 693 * (1000000000 // (1000 + 20 * 100)))]


def test_terms_end_with_their_text():
    counts, terms = ranked.terms_of(pa.array(["Ab", "cD", None, "", "_e_F1 é"]))
    assert counts.tolist() == [1, 1, 0, 0, 3] and terms.to_pylist() == ["ab", "cd", "e", "f1", "é"]


def test_few_segments_go_to_python_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ranked, "FEW_ROWS", {**ranked.FEW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": "4k"})
    docs = spark.createDataFrame([(i, " ".join(f"t{i + j}" for j in range(100))) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "t5 t6")], "item_id long, text string")
    sizes, frequencies = [], ranked._frequencies

    def spied(index, block):
        rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"]) for b in batches)
        sizes.extend(index.segments.mapInArrow(rows, "rows long, bytes long").collect())
        return frequencies(index, block)

    monkeypatch.setattr(ranked, "_frequencies", spied)
    before = {c: spark.conf.get(c) for c in ranked.FEW_ROWS}
    with Workspace(spark, "t") as work:
        index = ranked.build(docs.coalesce(1), work.path("segments"), work, segment_terms=100)
        ranked.search(index, asked, 5, work)
    assert sum(s.rows for s in sizes) == 200 and max(s.bytes for s in sizes) < 20_000
    # the session is as it was
    assert before == {c: spark.conf.get(c) for c in ranked.FEW_ROWS} and before["spark.sql.execution.arrow.maxBytesPerBatch"] != "4k"
