"""Models of every language over the whole vocabulary, cross-fitted; thresholds for every language."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import kneser_ney as kn


def _docs(spark, texts):
    """(lang, text) as documents by number."""
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string")


def _prose(seed: int, n: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    names = [f"w{seed}x{i}" for i in range(words)]
    return [" ".join(rng.choices(names, k=40)) for _ in range(n)]


def test_vocabulary_grows_with_the_corpus(spark):
    many = [" ".join(f"e{j}" for j in range(i, i + 600)) for i in range(0, 12_000, 600)]
    small = ["kleine sprache hat eigene worte"] * 2
    texts = [("en", f"{x} copy{c}") for x in many for c in range(8)] + [("de", f"{x} n{c}") for x in small for c in range(8)]
    model = kn.train(_docs(spark, texts))
    # both folds know nearly all 12000 words, and the small language's though the large one's are as frequent
    assert len(model.vocabulary.known) > 20_000
    found = {r["lang"]: r["found"] for r in kn.score(_docs(spark, [("de", "kleine sprache hat eigene worte"), ("en", "kleine sprache hat eigene worte")]), model).select("row.lang", "found").collect()}
    assert found["de"]["logp"] > found["en"]["logp"] + 5


def test_join_equals_broadcast(spark):
    docs = _docs(spark, [*[("en", x) for x in _prose(1, 40)], *[("de", x) for x in _prose(2, 12)], ("en", None), ("fr", "not taught"), (None, "a b"), ("de", "w1x1 w1x2")])
    model = kn.train(docs.where("lang IN ('en', 'de')"))
    rows = lambda df: {r[0]: (r[1]["n_words"], r[1]["logp"] if r[1]["logp"] is None else round(r[1]["logp"], 3)) for r in df.select("row.doc_id", "found").collect()}
    whole = rows(kn.score(docs, model))
    assert whole == rows(kn.score(docs, model, broadcast_ngrams=0))
    assert whole[53] == (2, None) and whole[54] == (2, None) and whole[55][1] < 0


def test_no_text_is_scored_by_a_model_that_saw_it(spark):
    # each text's words are its own: a model that saw it would know them
    docs = _docs(spark, [("en", " ".join(f"t{i}w{j % 5}" for j in range(20))) for i in range(30)])
    model = kn.train(docs)
    assert len(model.vocabulary.known) == 150
    known = kn.score(docs, model).select((F.col("found.logp") / F.col("found.n_words")).alias("mean")).collect()
    assert len(known) == 30 and max(r["mean"] for r in known) < -3


def test_few_trusted_texts_give_a_threshold(spark):
    junk = " ".join(f"zq{i}" for i in range(40))
    texts = [*[("en", x) for x in _prose(1, 120)], *[("es", x) for x in _prose(3, 10, words=12)], ("es", junk), ("en", junk), ("fr", junk)]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(130)], "doc_id long, quality int, toxic int")
    rows = kn.classify(docs, labels).select("row.doc_id", "lang", "threshold", "score", "kept").collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not kept[130] and not kept[131]
    # nothing is known of a language without trusted texts
    assert kept[132]
    # the quantile itself, without a margin: the lowest of 120 scores is not far below it
    held = sorted(r["score"] - r["threshold"] for r in rows if r["lang"] == "en" and r["doc_id"] < 120)
    assert held[0] < 0.02 and held[3] >= 0 and sum(kept[i] for i in range(130)) >= 126


def _brute(texts: list[str], min_count: int):
    """Probability of a word after another from whole dictionaries of counts, for one language and no folds."""
    split = [[w for w in re.split(r"[\s.,;:]+", t) if w] for t in texts]
    every = collections.Counter(w for t in split for w in t)
    known = {w for w, n in every.items() if n >= min_count}
    unknown = max(1, len(every) - len(known))
    name = lambda w: w if w in known else "?"
    pairs = collections.Counter()
    for t in split:
        pairs.update(zip(["^", *map(name, t)], map(name, t), strict=False))

    def losses(counts):
        n = [sum(c == i for c in counts) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0.5 * i if not n[i] else min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    follows = collections.Counter(w for _, w in pairs)
    lose_pair, lose_word = losses(list(pairs.values())), losses(list(follows.values()))
    all_follows, spare_words = sum(follows.values()), sum(lose_word(c) for c in follows.values())

    def p1(w):
        share = 1 / unknown if w == "?" else 1.0
        return (max(0, follows[w] - lose_word(follows[w])) + spare_words / (len(known) + 2)) / all_follows * share if follows[w] else math.exp(kn.UNSEEN)

    def p2(v, w):
        after = {b: n for (a, b), n in pairs.items() if a == v}
        if not after:
            return p1(w)
        total, spare = sum(after.values()), sum(lose_pair(n) for n in after.values())
        share = 1 / unknown if w == "?" else 1.0
        own = max(0, after[w] - lose_pair(after[w])) / total * share if w in after else 0
        return own + spare / total * p1(w)

    def logp(text):
        own = [name(w) for w in re.split(r"[\s.,;:]+", text) if w]
        return sum(math.log(p2(v, w)) for v, w in zip(["^", *own], own, strict=False))

    return logp


def test_probabilities_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=rng.randint(1, 30))) for _ in range(60)]
    asked = [*_prose(9, 3), *texts[:10], "w0 w1 w0 w0 never seen", "", "w39."]
    # two folds, each taught by the other's texts
    docs = _docs(spark, [("en", x) for x in texts])
    folds = {r["text"]: r["fold"] for r in docs.union(_docs(spark, [("en", x) for x in asked])).select(*kn.placed(docs, "lang", 2)).collect()}
    model = kn.train(docs)
    brute = [_brute([x for x in texts if folds[x] != m], kn.MIN_COUNT) for m in (0, 1)]
    for limit in (0, kn.BROADCAST_NGRAMS):
        found = {r[0]: r[1] for r in kn.score(_docs(spark, [("en", x) for x in asked]), model, broadcast_ngrams=limit).select("row.text", "found.logp").collect()}
        for x in asked:
            assert abs(found[x] - brute[folds[x]](x)) < 1e-3, x


def test_packed_keys_come_back():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (5, 1), (1000, 1 << 50), (1000, 20), (300, 1 << 62)):
        values = np.sort(rng.integers(0, top, n))
        assert (kn.unpack(*kn.pack(values)) == values).all()


def test_empty_tables_and_clashing_names(spark):
    docs = _docs(spark, [("en", x) for x in _prose(1, 30)]).withColumns({"_trusted": F.lit(1), "kept": F.lit("x"), "digest": F.lit("y"), "score": F.lit(0)})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert kn.classify(docs, labels).select("row.*").columns == docs.columns
    assert kn.classify(docs.limit(0), labels).count() == 0
    assert kn.classify(docs, labels.limit(0)).where("kept").count() == 30
