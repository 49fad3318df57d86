"""Blocks of the Jaccard join against all pairs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from corpusloom.llm import jaccard_join


def test_common_counts_shared_shingles(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in (1, 5, 60, 200)]
    got = jaccard_join._common(sets, sets[1:])
    assert got.astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[1:]] for a in sets]


@pytest.mark.parametrize(("block", "changes"), [(512, 6), (16, 6), (16, 2)])
def test_many_near_copies(spark, monkeypatch, block, changes):
    """Copies that drift from each other: some link, most don't, and all share regions."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block + changes)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        own = list(base) if i % 3 or not texts else texts[-1].split()
        for j in rng.sample(range(len(base)), changes):
            own[j] = f"x{i}-{j}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(map(tuple, brute.op7(rows)))
