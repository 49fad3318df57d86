"""The SQL of line dedup gives the query's rows."""

from __future__ import annotations

import duckdb

from corpusloom.llm import queries as q


def test_sql_gives_the_rows(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(q.LINE_DEDUP_SQL)
    got = q.op3_line_dedup(spark, sf_dir)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_both_count_texts_that_share_several_lines(spark, tmp_path):
    # the inner lines of a header have the same neighbours on every page
    rows = [(i, f"top of page\nmenu of page\n\nend of header\nown text {i}\n{i} more", "host") for i in range(60)] + [(100 + i, f"other {i}", "small") for i in range(3)] + [(200, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(q.LINE_DEDUP_SQL)
    got = q.op3_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got))) == sorted(map(repr, want.fetchall()))
    assert {r["n_dropped"] for r in got if r["doc_id"] < 60} == {3}
