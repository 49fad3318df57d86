"""Every registered query against its SQL, and the plain-Python forms of those without."""

from __future__ import annotations

import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar as s
from corpusloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def _plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    want = duck.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(_plain(r[c]) for c in want.columns) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(map(_plain, r)) for r in want.fetchall())


def test_point_ids(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    assert all(r["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{pages[r['page_id']]}_0")) for r in catalog.queries()["point_ids"](spark, sf_dir).collect())


def _cut(piece: str, size: int) -> set[int]:
    """Where a full piece may end: behind the first kind of mark that counts, or at its whole size."""
    beyond = lambda at: at > 0.3 * size
    kinds = [(piece.rfind("```"), 0), (piece.rfind("\n\n"), 0), (piece.rfind(". "), 1)]
    if beyond(kinds[0][0]):
        return {kinds[0][0]}
    # a blank line or sentence end that comes too early leaves no other choice
    return {at + more if beyond(at) else size for at, more in kinds[1:] if at >= 0 and (at, more) == next(k for k in kinds[1:] if k[0] >= 0)} or {size}


def test_chunks(spark, sf_dir):
    size = 100
    texts = ["", "   ", "a" * 250, "x. " * 100, "para\n\n" * 60, "code ```py\nx\n``` and " * 20, " " * 300 + "end", "é. ü " * 90, "ab```" + "c" * 200]
    literal = {0: [], 1: [""], 2: ["a" * 100, "a" * 100, "a" * 50], 6: ["end"], 8: ["ab```" + "c" * 95, "c" * 100, "c" * 5]}
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(30).collect()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["c"] for r in df.select("id", s.chunks(F.col("text"), size).alias("c")).collect()}
    assert {i: got[i] for i in literal} == literal
    for i, text in enumerate(texts):
        assert "".join("".join(got[i]).split()) == "".join(text.split()) and all(len(x) <= size for x in got[i])
        # every piece but the last ends where the marks of its window say
        rest = text
        for x in got[i][:-1]:
            while not rest[: min(_cut(rest[:size], size))].strip():
                rest = rest[min(_cut(rest[:size], size)) :]
            at = min(_cut(rest[:size], size))
            assert x == rest[:at].strip()
            rest = rest[at:]


def test_long_texts_are_cut_in_time(spark):
    df = spark.createDataFrame([(i, "Some words. " * 40_000) for i in range(4)], "id int, text string")
    assert df.select(F.size(s.chunks(F.col("text"), 1000)).alias("n")).agg(F.min("n")).first()[0] >= 480
