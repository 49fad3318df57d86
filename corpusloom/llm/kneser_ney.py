"""Quality classifier: perplexity under interpolated modified Kneser-Ney bigram models of trusted texts.

Words are runs without white space and `.,;:`, case kept. Each language has counts, a vocabulary, discounts
and totals of its own. The vocabulary is every word that occurs `min_count` times in the language's trusted texts, so
it grows with the corpus; other words are one class of the language, whose probability its different words share.
Counts come from all trusted texts: slices of them pack their sorted bigrams for each shard of the models, a shard adds up
what it is sent, and continuation counts and context totals are sums over the shards.

Models are cross-fitted: texts are dealt by content into `folds`, and a language's model of a fold learns from
the trusted texts of all other folds and scores the fold's texts. So all trusted texts teach, and none
is scored by a model that has seen it or a copy. A document's score is its mean log probability a word, with `prior_words` words
of its language's trusted mean added, so that short texts do not swing; its threshold is the
`quantile` of its language's held-out scores. How far it lies below the language's mean is shrunk towards the same of
all languages, which weighs as `prior_trusted` texts, so that few trusted texts do for a threshold. Lower scores are rejected. Only
the documents of a language without any trusted text have no model and no threshold, and stay.

Finished models stay in shards, each packed into a row. A slice of texts asks every shard for its bigrams: their
sorted keys are packed in a few bits each, with the text that each occurs in and how often, and the shard answers
with a sum for each text. Models of at most `broadcast_ngrams` bigrams together are broadcast instead. Different
texts are scored once, by digest, for thresholds and decisions both. The vocabulary (24 bytes a word, with its
back-off values) and the list of languages are always broadcast. A null or empty text has no words and is
rejected; a null language is a language of its own; labels without a document are not used; repeated rows are
scored alike; an empty table gives no rows; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NONSPACE, Words, materialise, mix, scratch, slices, words_of

MIN_COUNT, FOLDS = 3, 2
PRIOR_WORDS, QUANTILE, PRIOR_TRUSTED = 20, 0.01, 20
#: 12 bytes each in the broadcast; labelled ids (8 bytes) that are broadcast to find the trusted texts.
BROADCAST_NGRAMS, BROADCAST_LABELS = 4_000_000, 2_000_000
#: Trusted words, and so bigrams at most, that go to a shard of the models.
SHARD_WORDS = 1_000_000

WORD_BYTES = NONSPACE.copy()
WORD_BYTES[np.frombuffer(b".,;:", np.uint8)] = False


@dataclass
class Vocabulary:
    """Numbers of words. Each model (a language's of a fold) has words of its own, as its number is part of their keys.

    The first numbers are the models' unknown words, then their starts of a text, then the words by key.
    """

    languages: dict[str, int]
    folds: int
    taught: np.ndarray
    known: np.ndarray
    known_model: np.ndarray

    @property
    def models(self) -> int:
        return len(self.languages) * self.folds

    @property
    def base(self) -> int:
        return 2 * self.models + len(self.known)

    def numbers(self, w: Words, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each word and of the word before it, for texts of these models."""
        own = model[w.text]
        if len(self.known):
            keys = _keys(w, model)
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            own = np.where(self.known[at] == keys, at + 2 * self.models, own)
        before = np.concatenate([[0], own[:-1]]).astype(np.int64) if len(own) else own
        starts = w.first[:-1][np.diff(w.first) > 0]
        before[starts] = self.models + model[w.text[starts]]
        return own.astype(np.int64), before

    def scoring(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The model that scores each text (-1: the language has none), and whether it is the one of the text's fold."""
        lang, fold = _places(part, self.languages)
        model = np.full(len(lang), -1)
        # a fold without a model of its own takes the language's next
        for step in reversed(range(self.folds)):
            at = lang * self.folds + (fold + step) % self.folds
            there = (lang >= 0) & self.taught[np.maximum(at, 0)] if len(self.taught) else np.zeros(len(lang), bool)
            model[there] = at[there]
        return model, model == lang * self.folds + fold


@dataclass
class Model:
    """Vocabulary, and log probabilities of all models; a bigram's is logw of its first word, logp of its second and its gain.

    shards has a row for each shard: the packed keys of its bigrams and their gains. The arrays go by word number.
    """

    vocabulary: Vocabulary
    shards: DataFrame
    n_shards: int
    logw: np.ndarray
    logp: np.ndarray


def _keys(w: Words, model: np.ndarray) -> np.ndarray:
    return mix(w.hash ^ mix(model.astype(np.uint64) + np.uint64(1))[w.text])


def _places(part: pa.RecordBatch, languages: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    lang = np.array([languages.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
    return lang, part.column("fold").to_numpy().astype(np.int64)


def placed(docs: DataFrame, lang: str, folds: int) -> list:
    """Columns text, lang and fold (by content)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [text.alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(folds)).cast("int").alias("fold")]


def _bits(values: np.ndarray, width: int) -> bytes:
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def pack(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted int64 values in few bits: the first, and of steps from it the low bits, and the high ones as unary gaps."""
    steps = values - values[0]
    width = max(0, int(steps[-1] // len(steps)).bit_length() - 1)
    high = (steps >> width) + np.arange(len(steps))
    marks = np.zeros(int(high[-1]) + 1, bool)
    marks[high] = True
    return int(values[0]), width, _bits(steps & ((1 << width) - 1), width) if width else b"", np.packbits(marks, bitorder="little").tobytes()


def unpack(first: int, width: int, low: bytes, high: bytes) -> np.ndarray:
    marks = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))
    out = (marks - np.arange(len(marks))) << width
    if width:
        wide = np.zeros((len(marks), 64), np.uint8)
        wide[:, :width] = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")[: len(marks) * width].reshape(-1, width)
        out += np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()
    return out + first


#: Of a packed run of keys.
_PACKED = "first bigint, width int, low binary, high binary"
_PACKED_NAMES = ["first", "width", "low", "high"]


def _runs(keys: np.ndarray, n_shards: int, **columns: np.ndarray) -> Iterator[dict]:
    """A row for each shard (a key's remainder): the packed keys, and the other columns as bytes; `keys` are in order of shard and key."""
    shard = keys % n_shards
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = {c: x[lo:hi] for c, x in columns.items()}
        yield {"shard": int(shard[lo])} | dict(zip(_PACKED_NAMES, pack(keys[lo:hi] // n_shards), strict=True)) | {c: x.astype("<u1" if x.max() < 1 << 8 else "<u4").tobytes() for c, x in own.items()}


def _column(row: dict, name: str, size: int) -> np.ndarray:
    return np.frombuffer(row[name], f"<u{len(row[name]) // size}")


def _counted(texts: DataFrame, work, name: str, languages: dict[str, int], folds: int) -> DataFrame:
    """Sums of the counts that `work` makes of each slice, by model and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, fold = _places(part, languages)
                w = words_of(part.column("text"), WORD_BYTES, False)
                for m in range(folds):
                    learns = (fold != m)[w.text]
                    model = lang * folds + m
                    keys, of = work(w, model)
                    u, at, n = np.unique(keys[learns], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(of[learns][at], pa.int64()), pa.array(u.view(np.int64)), pa.array(n, pa.int64())], ["model", name, "n"])

    return texts.mapInArrow(run, f"model bigint, {name} bigint, n bigint").groupBy("model", name).agg(F.sum("n").alias("n"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ of each model, by its numbers of counts of 1, 2, 3 and 4 (a row a model)."""
    y = np.where(n[:, 0] > 0, n[:, 0] / np.maximum(1, n[:, 0] + 2 * n[:, 1]), 0.5)
    d = [np.where(n[:, i - 1] > 0, np.minimum(i, np.maximum(0.05, i - (i + 1) * y * n[:, i] / np.maximum(1, n[:, i - 1]))), 0.5 * i) for i in (1, 2, 3)]
    return np.stack(d, 1)


def _tallies(counts: np.ndarray) -> np.ndarray:
    """Which of the columns 1, 2, 3, 4 and more each count falls in."""
    return np.minimum(counts, 5) - 1


_COUNTED = f"shard int, {_PACKED}, counts binary"
_COUNTED_NAMES = ["shard", *_PACKED_NAMES, "counts"]
_TALLIED = "follows boolean, number int, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n5 bigint"


def _bigrams(texts: DataFrame, vocabulary: Vocabulary, n_shards: int, sent) -> DataFrame:
    """A row for each shard: its packed bigrams and their counts."""
    base = vocabulary.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in slices(batch):
                lang, fold = _places(part, vocabulary.languages)
                w = words_of(part.column("text"), WORD_BYTES, False)
                pairs = []
                for m in range(vocabulary.folds):
                    own, before = vocabulary.numbers(w, lang * vocabulary.folds + m)
                    pairs.append((before * base + own)[(fold != m)[w.text]])
                keys, n = np.unique(np.concatenate(pairs), return_counts=True)
                order = np.lexsort((keys, keys % n_shards))
                yield _table(list(_runs(keys[order], n_shards, counts=n[order])), _COUNTED_NAMES)

    def added(given: pa.Table) -> pa.Table:
        rows = given.to_pylist()
        keys = [unpack(*(r[c] for c in _PACKED_NAMES)) for r in rows]
        n = np.concatenate([_column(r, "counts", len(k)).astype(np.int64) for r, k in zip(rows, keys, strict=True)])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        whole = keys[new] * n_shards + rows[0]["shard"]
        return pa.Table.from_batches([_table(list(_runs(whole, n_shards, counts=np.add.reduceat(n, new))), _COUNTED_NAMES)])

    return texts.mapInArrow(run, _COUNTED).groupBy("shard").applyInArrow(added, _COUNTED)


def _pairs(row: dict, base: int, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, second words and counts of a shard's bigrams."""
    pair = unpack(*(row[c] for c in _PACKED_NAMES)) * n_shards + row["shard"]
    return pair // base, pair % base, _column(row, "counts", len(pair)).astype(np.int64)


def _tallied(bigrams: DataFrame, base: int, n_shards: int) -> DataFrame:
    """For each first word the sum of its bigrams' counts, and how many are 1, 2, 3, 4 and more; for each second word (`follows`) how many different words it follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before, own, n = _pairs(row, base, n_shards)
                first, at = np.unique(before, return_inverse=True)
                second, follows = np.unique(own, return_counts=True)
                tallies = np.zeros((len(first), 5), np.int64)
                np.add.at(tallies, (at, _tallies(n)), 1)
                none = np.zeros(len(second), np.int64)
                columns = [np.repeat([False, True], [len(first), len(second)]), np.concatenate([first, second]).astype(np.int32), np.concatenate([np.bincount(at, n).astype(np.int64), follows]), *(np.concatenate([tallies[:, k], none]) for k in range(5))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["follows", "number", "total", *(f"n{k}" for k in range(1, 6))])

    sums = [F.sum("total").alias("total"), *(F.sum(f"n{k}").cast("int").alias(f"n{k}") for k in range(1, 6))]
    return bigrams.select(*_COUNTED_NAMES).mapInArrow(run, _TALLIED).groupBy("follows", "number").agg(*sums)


def _gained(bigrams: DataFrame, base: int, n_shards: int, sent) -> DataFrame:
    """A row for each shard: packed bigrams and what each adds to its words' log probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, discounts, total, weight, p, share = sent.value
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                before, own, n = _pairs(row, base, n_shards)
                lost = discounts[of[before], np.minimum(n, 3) - 1]
                seen = np.maximum(n - lost, 0) / total[before] * share[own]
                rows.append(row | {"gains": np.log1p(seen / (weight[before] * p[own])).astype("<f4").tobytes()})
            yield _table(rows, ["shard", *_PACKED_NAMES, "gains"])

    return bigrams.mapInArrow(run, f"shard int, {_PACKED}, gains binary")


def train(trusted: DataFrame, *, lang: str = "lang", min_count: int = MIN_COUNT, folds: int = FOLDS) -> Model:
    """The models of all `trusted` texts: one for each language and fold."""
    # only the finished tables stay
    with scratch(trusted.sparkSession):
        return _trained(trusted, lang, min_count, folds)


def _trained(trusted: DataFrame, lang: str, min_count: int, folds: int) -> Model:
    texts = trusted.select(*placed(trusted, lang, folds))
    languages = {r[0]: i for i, r in enumerate(sorted(texts.select("lang").distinct().collect()))}
    counts = materialise(_counted(texts, lambda w, model: (_keys(w, model), model[w.text]), "word", languages, folds), "words")
    many = counts.where(F.col("n") >= min_count).select("word", "model").toArrow()
    known, known_model = many["word"].to_numpy().view(np.uint64), many["model"].to_numpy().astype(np.int32)
    order = np.argsort(known)
    models = len(languages) * folds
    taught, whole, unknown, words = np.zeros(models, bool), np.ones(models), np.ones(models), 0
    # one row a model
    for r in counts.groupBy("model").agg(F.count(F.when(F.col("n") >= min_count, 1)).alias("known"), F.count(F.lit(1)).alias("all"), F.sum("n").alias("words")).collect():
        taught[r["model"]], whole[r["model"]], unknown[r["model"]] = True, r["known"] + 2, max(1, r["all"] - r["known"])
        words += r["words"]
    vocabulary = Vocabulary(languages, folds, taught, known[order], known_model[order])
    base, sc = vocabulary.base, trusted.sparkSession.sparkContext
    n_shards = max(int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / SHARD_WORDS))
    while math.gcd(n_shards, max(1, base)) > 1:
        n_shards += 1
    bigrams = materialise(_bigrams(texts, vocabulary, n_shards, sc.broadcast(vocabulary)), "bigrams")
    tallied = materialise(_tallied(bigrams, base, n_shards), "tallies").toArrow()
    of = np.concatenate([np.arange(models), np.arange(models), vocabulary.known_model]).astype(np.int32)
    follows, number, sums = tallied["follows"].to_numpy(), tallied["number"].to_numpy(), tallied["total"].to_numpy()
    total, tallies, k = np.zeros(base), np.zeros((base, 5)), np.zeros(base, np.int64)
    total[number[~follows]], k[number[follows]] = sums[~follows], sums[follows]
    for c in range(5):
        tallies[number[~follows], c] = tallied[f"n{c + 1}"].to_numpy()[~follows]
    by_model = np.stack([np.bincount(of, tallies[:, c], models) for c in range(4)], 1) if base else np.zeros((0, 4))
    discounts = _discounts(by_model)
    # what a first word's bigrams lose goes to all words, by how many different words they follow
    spare = (tallies * discounts[of][:, [0, 1, 2, 2, 2]]).sum(1)
    weight = spare / np.maximum(1, total)
    following = _discounts(np.stack([np.bincount(of[k == c], minlength=models) for c in (1, 2, 3, 4)], 1) if base else np.zeros((0, 4)))
    lost = np.where(k > 0, following[of, np.clip(k, 1, 3) - 1], 0)
    all_k, all_lost = np.bincount(of, k, models), np.bincount(of, lost, models)
    share = np.where(np.arange(base) < models, 1 / unknown[of], 1.0)
    # unknown words share their class's probability
    p = np.where(k > 0, (np.maximum(k - lost, 0) + all_lost[of] / whole[of]) / np.maximum(1, all_k[of]) * share, 1.0)
    shards = materialise(_gained(bigrams, base, n_shards, sc.broadcast((of, discounts, np.maximum(1, total), np.where(total > 0, weight, 1.0), p, share))), "model", keep=True)
    return Model(vocabulary, shards, n_shards, np.where(total > 0, np.log(np.where(total > 0, weight, 1.0)), 0.0), np.where(k > 0, np.log(p), UNSEEN))


#: Log probability of a word that the model never saw follow anything.
UNSEEN = -20.0


class _Lookup:
    """The model's tables as arrays by word number; bigrams only where they are broadcast."""

    def __init__(self, model: Model, bigrams: bool):
        self.vocabulary, self.base = model.vocabulary, model.vocabulary.base
        self.logw, self.logp = model.logw, model.logp
        self.n_shards, self.pair, self.gain = model.n_shards, np.zeros(0, np.int64), np.zeros(0, np.float32)
        found = model.shards.toArrow().to_pylist() if bigrams else []
        if found:
            pair = np.concatenate([unpack(*(r[c] for c in _PACKED_NAMES)) * model.n_shards + r["shard"] for r in found])
            order = np.argsort(pair)
            self.pair, self.gain = pair[order], np.concatenate([np.frombuffer(r["gains"], "<f4") for r in found])[order]

    def scores(self, part: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """n_words, log probability (without bigrams that are not here) and held_out of each text; the text and bigram of each word."""
        w = words_of(part.column("text"), WORD_BYTES, False)
        model, held_out = self.vocabulary.scoring(part)
        if not self.base:
            return [pa.array(w.count(), pa.int64()), pa.nulls(len(model), pa.float64()), pa.array(held_out)], w.text[:0], w.text[:0]
        own, before = self.vocabulary.numbers(w, np.maximum(model, 0))
        out = self.logw[before] + self.logp[own]
        pair = before * self.base + own
        if len(self.pair) and len(own):
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            out += np.where(self.pair[at] == pair, self.gain[at], 0)
        total = np.concatenate([[0.0], np.cumsum(out)])
        there = model[w.text] >= 0
        return [pa.array(w.count(), pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.float64(), mask=model < 0), pa.array(held_out)], w.text[there], pair[there]


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("logp", T.DoubleType()), T.StructField("held_out", T.BooleanType())])
#: Passes over the texts in which the shards are asked.
PASSES = 2
#: Texts that ask together; their numbers fit a byte.
TEXTS = 256
#: Digests that a task remembers, so that most copies in it are scored once.
REMEMBERED = 500_000


def _keyed(docs: DataFrame, names: list[str], lang: str) -> DataFrame:
    """`row` with the named columns, lang, and the digest of language and text."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *placed(docs, lang, 1))
    return given.select("row", "lang", F.unhex(F.md5(F.concat("lang", F.lit("\0"), "text"))).alias("digest"))


def scores(docs: DataFrame, model: Model, *, lang: str = "lang", broadcast_ngrams: int = BROADCAST_NGRAMS, passes: int = PASSES) -> DataFrame:
    """digest of each different language and text, n_words, its log probability (null: no trusted text of its language), and whether its model is its fold's."""
    given = docs.select(*placed(docs, lang, model.vocabulary.folds)).withColumn("digest", F.unhex(F.md5(F.concat("lang", F.lit("\0"), "text"))))
    whole = model.shards.agg(F.sum(F.octet_length("gains") / 4)).first()[0] or 0
    whole = whole <= broadcast_ngrams
    sent = docs.sparkSession.sparkContext.broadcast(_Lookup(model, whole))
    if not whole:
        with scratch(docs.sparkSession):
            # a pass asks its share of the shards, so that what is under way at a time stays small
            parts = [materialise(_asked(given, model, sent, k, passes), "asked") for k in range(passes)]
            every = functools.reduce(DataFrame.unionByName, parts).groupBy("digest")
            return materialise(every.agg(F.max("n_words").alias("n_words"), F.sum("logp").alias("logp"), F.max("held_out").alias("held_out")), "scores", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("digest"), *sent.value.scores(part)[0]], out.fieldNames())

    out = T.StructType([T.StructField("digest", T.BinaryType()), *FOUND.fields])
    return materialise(given.mapInArrow(run, out).dropDuplicates(["digest"]), "scores", keep=True)


_ASKED = f"shard int, kind int, batch binary, {_PACKED}, texts binary, counts binary, gains binary, digests binary, found binary, parts int"
_ASKED_TYPES = {"shard": pa.int32(), "kind": pa.int32(), "batch": pa.binary(), "first": pa.int64(), "width": pa.int32(), "parts": pa.int32()}
_ASKED_NAMES = [x.split()[0] for x in _ASKED.split(", ")]
_SUMS = "batch binary, sums binary, digests binary, found binary, parts int"


def _table(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ASKED_TYPES.get(c, pa.binary())) for c in names], names)


def _asked(given: DataFrame, model: Model, sent, turn: int, passes: int) -> DataFrame:
    """Sums of a pass by digest: by the shards, in the first pass with what needs no bigrams.
    kind 0: a shard; 1: what a slice of texts asks of it; 2: the slice's digests and what is known without bigrams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                digests = part.column("digest").to_pylist()
                new = list({d: k for k, d in enumerate(digests) if d not in seen}.values())
                if not new:
                    continue
                if len(seen) < REMEMBERED:
                    seen.update(digests)
                for at in range(0, len(new), TEXTS):
                    some = new[at : at + TEXTS]
                    (n_words, logp, held_out), text, pair = sent.value.scores(part.take(pa.array(some)))
                    own = pair % sent.value.n_shards % passes == turn
                    text, pair = text[own], pair[own]
                    known = np.rec.fromarrays([n_words.to_numpy(), logp.to_numpy(zero_copy_only=False) * (turn == 0), held_out.to_numpy(zero_copy_only=False)], dtype=_KNOWN)
                    rows = list(_requests(text, pair, sent.value.n_shards, len(some)))
                    held = b"".join(digests[k] for k in some)
                    name = hashlib.blake2b(held, digest_size=16).digest()
                    rows.append({"shard": name[0] % sent.value.n_shards, "kind": 2, "digests": held, "found": known.tobytes(), "parts": len(rows)})
                    yield _table([r | {"batch": name} for r in rows], _ASKED_NAMES)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, gains = -1, np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    shard, keys, gains = r["shard"], unpack(*(r[c] for c in _PACKED_NAMES)), np.frombuffer(r["gains"], "<f4").astype(np.float64)
                elif r["kind"] == 2:
                    rows.append(r)
                else:
                    own = unpack(*(r[c] for c in _PACKED_NAMES))
                    texts, counts = _column(r, "texts", len(own)), _column(r, "counts", len(own))
                    gain = np.zeros(len(own))
                    if shard == r["shard"]:
                        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        gain = np.where(keys[at] == own, gains[at], 0) * counts
                    rows.append({"batch": r["batch"], "sums": np.bincount(texts, gain, r["parts"]).astype("<f4").tobytes()})
            if rows:
                yield _table(rows, ["batch", "sums", "digests", "found", "parts"])

    def gathered(given: pa.Table) -> pa.Table:
        rows = given.to_pylist()
        # a slice that several tasks hold is asked for by each of them, and answered alike
        known = next((r for r in rows if r["digests"] is not None), None)
        copies = sum(r["digests"] is not None for r in rows)
        sums = [np.frombuffer(r["sums"], "<f4") for r in rows if r["sums"] is not None]
        if known is None or len(sums) != copies * known["parts"]:
            raise RuntimeError("the input gave other rows when it was read again; write it first")
        found = np.frombuffer(known["found"], _KNOWN)
        logp = found["logp"] + (np.sum(sums, 0, dtype=np.float64) / copies if sums else 0)
        digests = [known["digests"][k : k + 16] for k in range(0, len(known["digests"]), 16)]
        return pa.table({"digest": pa.array(digests, pa.binary()), "n_words": found["n_words"], "logp": pa.array(logp, mask=np.isnan(logp)), "held_out": found["held_out"]})

    shards = model.shards.where(F.col("shard") % passes == turn).select("shard", F.lit(0).alias("kind"), *_PACKED_NAMES, "gains")
    asked = given.mapInArrow(ask, _ASKED).unionByName(shards, allowMissingColumns=True)
    # a shard comes before what is asked of it
    answered = asked.repartition(model.n_shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, _SUMS)
    found = answered.groupBy("batch").applyInArrow(gathered, "digest binary, n_words bigint, logp double, held_out boolean")
    return found.dropDuplicates(["digest"])


_KNOWN = np.dtype([("n_words", "<i8"), ("logp", "<f8"), ("held_out", "?")])


def _requests(text: np.ndarray, pair: np.ndarray, n_shards: int, n_texts: int) -> Iterator[dict]:
    """A row for each shard that is asked: packed keys, and the text and count of each."""
    order = np.lexsort((text, pair, pair % n_shards))
    text, pair = text[order], pair[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])[: len(pair)])
    counts = np.diff(np.append(new, len(pair)))
    for row in _runs(pair[new], n_shards, texts=text[new], counts=counts):
        yield row | {"kind": 1, "parts": n_texts}


def score(docs: DataFrame, model: Model, *, lang: str = "lang", keep: list[str] | None = None, broadcast_ngrams: int = BROADCAST_NGRAMS) -> DataFrame:
    """`row` and `found`: n_words, the text's log probability (null: no trusted text of its language), and whether its model is its fold's."""
    keyed = _keyed(docs, docs.columns if keep is None else keep, lang)
    found = scores(docs, model, lang=lang, broadcast_ngrams=broadcast_ngrams)
    return keyed.join(found.select("digest", F.struct(*FOUND.fieldNames()).alias("found")), "digest").select("row", "found")


def trusted_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled good and not toxic."""
    ids = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND toxic = 0").select("doc_id")
    if labels.count() <= BROADCAST_LABELS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    lang: str = "lang",
    keep: list[str] | None = None,
    prior_words: int = PRIOR_WORDS,
    quantile: float = QUANTILE,
    prior_trusted: int = PRIOR_TRUSTED,
    broadcast_ngrams: int = BROADCAST_NGRAMS,
    **training,
) -> DataFrame:
    """`row` with lang, n_words, perplexity, threshold (of the score) and kept."""
    trusted = trusted_of(docs, labels)
    model = train(trusted, lang=lang, **training)
    found = scores(docs, model, lang=lang, broadcast_ngrams=broadcast_ngrams)
    seen = _keyed(trusted, [], lang).select("lang", "digest").join(found, "digest").where("n_words > 0 AND held_out")
    seen = materialise(seen, "trusted", keep=True)
    means = materialise(seen.groupBy("lang").agg((F.sum("logp") / F.sum("n_words")).alias("mean"), F.count(F.lit(1)).alias("n_trusted")), "means", keep=True)
    all_mean = seen.agg(F.sum("logp") / F.sum("n_words")).first()[0] or 0.0
    smooth = lambda mean: (F.col("logp") + prior_words * mean) / (F.col("n_words") + prior_words)
    mean = F.coalesce("mean", F.lit(all_mean))
    # a score's distance from its language's mean can be compared between languages
    scored = seen.join(F.broadcast(means), "lang").select("lang", "mean", "n_trusted", (smooth(F.col("mean")) - F.col("mean")).alias("off"))
    low = F.percentile_approx("off", quantile, 10_000)
    all_low = scored.agg(low).first()[0] or 0.0
    shrunk = (F.col("n_trusted") * low + prior_trusted * all_low) / (F.col("n_trusted") + prior_trusted)
    by_lang = scored.groupBy("lang", "mean", "n_trusted").agg((F.col("mean") + shrunk).alias("threshold")).drop("n_trusted")
    names = list(dict.fromkeys([*(docs.columns if keep is None else keep), lang]))
    out = _keyed(docs, names, lang).join(found, "digest")
    # one row a language with a held-out trusted text
    given = F.coalesce("threshold", F.when(F.col("logp").isNotNull(), all_mean + all_low), F.lit(float("-inf")))
    out = out.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", given).withColumn("score", smooth(mean))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))
    return out.select("row", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("logp") / F.col("n_words"))).alias("perplexity"), "score", "threshold", kept.alias("kept"))
