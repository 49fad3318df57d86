"""Alignment against plain Python, whole and with counts in small ranges."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from corpusloom.llm import align
from corpusloom.llm import queries as q
from corpusloom.llm.workspace import Workspace

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    signs = [" ", "  ", "\n", "\t", "\r", " ", " ", "　", "\x0b", "\x1c", "\u0085", "a", "bc", "é", "ß", "'s", "12", "!!", "日本", "🙂", "́", "{", ");\r", "<s>", "<0x41>", "<|endoftext|>", "İ", "the", "ing"]
    texts = [None, "", " ", "\n", "a", "  a", "a  ", "\n\n b", "x▁y", "▁", "the the", "the the", "x" * 5000, "word " * 20_000, "\x00", "日本語" * 500, " \t\n "]
    texts += ["".join(rng.choices(signs, k=rng.choice([3, 10, 60]))) for _ in range(400)]
    own = str(tmp_path_factory.mktemp("align"))
    spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)] + [(3, "the the", "r", 1)], "doc_id long, text string, `row` string, n_a int").repartition(3).write.parquet(f"{own}/documents.parquet")
    return own


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1:]))


@pytest.mark.parametrize("given", [True, False])
def test_query_equals_brute_force(spark, sf_dir, folder, given):
    at = sf_dir if given else folder
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    want = _sorted(brute.op12(docs, q.tokenizer_path("byte_bpe_50k.json"), q.tokenizer_path("piece_bpe_32k.model")))
    assert _sorted(q.op12_alignment(spark, at).select(*COLUMNS).collect()) == want


def test_ranges_of_counts_give_the_same(spark, sf_dir):
    paths = q.tokenizer_path("byte_bpe_50k.json"), q.tokenizer_path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    with Workspace(spark, "t") as work:
        aligned = work.store(align.align(docs, *paths), "aligned")
        counts = work.store(align.pair_counts(aligned, 32_000), "counts")
        once, often = (align.score(aligned, counts, work, range_pairs=n).select("row.doc_id", "n_best", "count_sum").collect() for n in (10**6, counts.count() // 5))
    assert len(once) == 40 and _sorted(once) == _sorted(often)


def test_groups_are_text_and_empty_tables_give_no_rows(spark):
    paths = q.tokenizer_path("byte_bpe_50k.json"), q.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([("the",), (None,)], "text string")
    rows = align.align(docs, *paths).select("row.text", "found.groups", "found.n_links").collect()
    assert [(r.text, r.n_links) for r in rows] == [("the", 1), (None, 0)] and rows[0].groups.count("|") == 1 and rows[1].groups == ""
    assert align.align(docs.limit(0), *paths).count() == 0


def test_merge_emits_links_and_cuts_of_all_runs():
    # run 0: A 2+2+1, B 1+3+1; run 1: one token each
    link_a, link_b, cut_a, cut_b = align.merge(np.array([0, 3, 4]), np.array([0, 3, 4]), np.array([2, 4, 5, 9]), np.array([1, 4, 5, 9]))
    assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3)]
    assert sorted(zip(cut_a.tolist(), cut_b.tolist(), strict=True)) == [(1, 1), (2, 2), (3, 3)]
