"""The queries against plain Python, on the smallest tables and on rows made to be awkward."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries as q


def _awkward() -> list[str | None]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    near = [list(base) for _ in range(12)]
    for i, own in enumerate(near):
        for j in range(i % 5):
            own[rng.randrange(len(own))] = f"x{i}{j}"
    half = base[:60] + rng.choices(words, k=60)
    long = " ".join(rng.choices(words, k=30_000))
    texts: list[str | None] = [
        None, "", " ", "\n\n", "one", "one", "One", "a b c", "A\tb c", "x" * 9000, "é" * 5000 + "! 12", long, long + " tail",
        "Same line\nother\nSame line\nsame LINE\n \n", "a b c d e a b c d e f g h i j k", "THE!! BIG** |#<>&%$",
        "mail a.b@c.de, x@y, a@b.c_d@e.f.g and @no.com 1.2.3.4 999.1.2.3.4 1.2.3.4.5.6.7.8 255.255.255.255 0256.1.1.1 00.0.0.0001",
        "card 4207051279108084 4207 0512-7910 8084 5 4207051279108084 42070512791080841234 +1 (375) 555-4393 +12 +1234567890123456 +1 2 3. +49 30 1234567",
        "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, ssn 123-45-6789 or not 123-45-6789",
        "Licensed under CC BY-NC 4.0. All Rights Reserved; all rights, reserved. GNU General Public License general public license",
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", "cc", "by cc by",
        "<|endoftext|> </w> it's they'LL x's 'sa ́é H̱ ſŉ İ ÷×² 日本語 abc日.def 0123", "\x00\x1c\x85 a b",
        *[" ".join(x) for x in near], " ".join(half), " ".join(base), " ".join(base).upper(), " ".join(base[:100]), " ".join(base[20:]),
    ]
    return texts + texts[3:9]


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The given tables, and a folder of awkward documents with further columns."""
    own = str(tmp_path_factory.mktemp("awkward"))
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 3}" if i % 5 else None, 1, "r", "f", 7) for i, t in enumerate(_awkward())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, found string, n_words int").repartition(3).write.parquet(f"{own}/documents.parquet")
    item = " ".join(_awkward()[11].split()[100:125])
    spark.createDataFrame([(1, item), (2, None), (3, ""), (10, "one"), (11, "W1, w2!"), (None, "b c")], "item_id long, text string").write.parquet(f"{own}/benchmark.parquet")
    spark.createDataFrame([(i, i % 7 != 0, 0) for i in range(40)], "doc_id long, quality boolean, toxic int").select("doc_id", F.col("quality").cast("int"), "toxic").write.parquet(f"{own}/labels.parquet")
    return [sf_dir, own]


def _docs(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: r[0])


def _by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


@pytest.mark.parametrize("k", [0, 1])
def test_decontamination(spark, folders, k):
    items = [tuple(r) for r in spark.read.parquet(f"{folders[k]}/benchmark.parquet").select("item_id", "text").collect()]
    # an item without an id marks words but is no item
    want = []
    for row, bare in zip(brute.op1(_docs(spark, folders[k]), items), brute.op1(_docs(spark, folders[k]), [x for x in items if x[0] is not None]), strict=True):
        want.append((*row[:3], *bare[3:5], row[5]))
    got = _rows(q.op1_decontamination(spark, folders[k]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == _by_id(want)


@pytest.mark.parametrize("k", [0, 1])
def test_quality_rules(spark, folders, k):
    got = _rows(q.op2_quality_rules(spark, folders[k]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [r[:7] for r in got] == _by_id(brute.op2(_docs(spark, folders[k])))
    assert not any(r[6] and r[7] for r in got)


@pytest.mark.parametrize("k", [0, 1])
def test_token_files(spark, folders, k):
    got = _rows(q.op4_token_files(spark, folders[k]), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == _by_id(brute.op4(_docs(spark, folders[k]), q.tokenizer_path()))


@pytest.mark.parametrize("k", [0, 1])
def test_pii(spark, folders, k):
    got = _rows(q.op5_pii(spark, folders[k]), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert [r[:6] for r in got] == _by_id(brute.op5(_docs(spark, folders[k])))
    if k:
        texts = dict(_docs(spark, folders[k]))
        found = [texts[r[0]][int(s.split(":")[1]) : int(s.split(":")[2])] for r in got for s in r[6].split(",") if s.startswith(("iban", "ssn"))]
        assert sorted(found)[:3] == ["123-45-6789", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]


@pytest.mark.parametrize("k", [0, 1])
def test_licenses(spark, folders, k):
    got = _rows(q.op6_licenses(spark, folders[k]), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [r[:6] for r in got] == _by_id(brute.op6(_docs(spark, folders[k])))
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) | {""} and 0 <= r[7] <= 1 for r in got)
    if k:
        labels = {dict(_docs(spark, folders[1]))[r[0]]: r[6] for r in got}
        assert any("apache-2.0" in v and "gpl-3.0" in v for v in labels.values())


@pytest.mark.parametrize("k", [0, 1])
def test_jaccard_join(spark, folders, k):
    assert _rows(q.op7_jaccard_join(spark, folders[k]), "doc_id", "n_shingles", "component_id") == _by_id(brute.op7(_docs(spark, folders[k])))


@pytest.mark.parametrize("k", [0, 1])
def test_sharding(spark, folders, k):
    got = _rows(q.op8_sharding(spark, folders[k]), "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "law")
    assert [r[:3] for r in got] == _by_id(brute.op8(_docs(spark, folders[k])))
    for shard in range(16):
        own = sorted(r[4] for r in got if r[3] == shard)
        assert own == list(range(len(own)))
    assert all(r[5] in (r[3], 16) and r[6] == "key" for r in got)


@pytest.mark.parametrize("k", [0, 1])
def test_bpe(spark, folders, k):
    got = _rows(q.op10_bpe(spark, folders[k]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == _by_id(brute.op10(_docs(spark, folders[k]), q.tokenizer_path()))


@pytest.mark.parametrize("k", [0, 1])
def test_line_dedup_and_classifier_run(spark, folders, k):
    n = len(_docs(spark, folders[k]))
    got = q.op3_line_dedup(spark, folders[k]).collect()
    assert len(got) == n and all(r["n_dropped"] <= r["n_lines"] for r in got)
    assert q.op9_quality_classifier(spark, folders[k]).count() == n
