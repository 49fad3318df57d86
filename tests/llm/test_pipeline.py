"""Every stage of the pipeline against plain Python on its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup
from corpusloom.llm import queries as q
from corpusloom.llm.common import materialise, table


def _norm(line):
    return brute.lower(line.strip(" \t\r"))


def _without_boilerplate(rows):
    """The texts of rows without lines that too many different texts of their source hold."""
    texts = {(r["source"] or "", r["text"]) for r in rows if r["text"] is not None}
    pages = Counter(host for host, _ in texts)
    held = Counter((host, line) for host, text in texts for line in {_norm(x) for x in text.split("\n")} - {""})
    gone = {k for k, n in held.items() if n >= line_dedup.MIN_PAGES and n / pages[k[0]] > line_dedup.MAX_RATIO}
    return {r["doc_id"]: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"] or "", _norm(x)) not in gone) for r in rows}


def _awkward(spark, folder):
    same = [f"Menu\nHome\nOwn words of page {i} that no other page has, {i * 7} and {i * 11}\nFooter" for i in range(30)]
    # ten words of a page that the classifier keeps
    passage = "own words of page 5 that no other page has"
    texts = [None, "", "\n", *same, same[0], same[0] + " more", "x y z " * 3000, "one"]
    rows = [(i, t, ["en", None][i % 2], "host" if i > 2 else None, 5, "r", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, _key int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 25), 0) for i in range(3, 38)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("kind", ["given", "awkward"])
def test_stages(spark, sf_dir, tmp_path, kind):
    folder = sf_dir
    if kind == "awkward":
        folder = str(tmp_path)
        _awkward(spark, folder)
    docs = table(spark, folder, "documents")
    columns = docs.columns
    taken = []
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, folder), f"test-{name.replace(' ', '-')}")
        assert docs.columns == columns
        taken.append((before, docs.collect()))
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    (given, kept), (_, cleaned), (_, single), (_, unseen) = taken
    verdicts = {r["doc_id"] for r in q.op9_quality_classifier(spark, folder).where("kept").collect()}
    assert ids(kept) == sorted(verdicts)
    assert set(kept) <= set(given)

    want = _without_boilerplate(kept)
    assert {r["doc_id"]: r["text"] for r in cleaned} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cleaned)

    classes = brute.op7([(r["doc_id"], r["text"]) for r in cleaned])
    assert ids(single) == sorted(doc for doc, n, least in classes if n == 0 or doc == least)

    items = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    marks = list(brute.op1([(r["doc_id"], r["text"]) for r in single], items))
    assert ids(unseen) == sorted(m[0] for m in marks if not m[-1])
    assert any(m[-1] for m in marks)

    got = p.STAGES[-1][1](spark, docs, folder).select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256), "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute.op10([(r["doc_id"], r["text"]) for r in unseen], q.tokenizer_path())))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark", "labels", "pages"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
    for name, query in q.queries().items():
        if name.startswith("op"):
            assert query(spark, str(tmp_path)).collect() == [], name
