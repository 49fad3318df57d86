"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against token windows of documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is `ngram` consecutive
words of an item; an item of fewer words, but not none, is one window. Window hashes find candidates,
the words themselves decide. A null or empty text has no words, so no hit; null items are skipped;
an item without an id marks words but adds no id. Repeated rows each get their own result.

The set of windows is broadcast only if the benchmark has at most `broadcast_windows` words in all;
beyond that, windows of documents join windows of items in a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, materialise, per_text, words_of

NGRAM = 10
#: About 100 bytes each in the broadcast.
BROADCAST_WINDOWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
    ]
)


class WindowSet:
    """Windows of all items: hash -> candidates by length, and the words of each with its items."""

    def __init__(self, items: list[tuple[str | None, str]], ngram: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        hashes: dict[int, set[int]] = defaultdict(set)
        w = words_of(pa.array([t for _, t in items], pa.string()), ALNUM, True)
        for k, (item, _) in enumerate(items):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            length = min(ngram, hi - lo)
            for i in range(lo, hi - length + 1 if length else lo):
                self.items[phrase(w, i, length)] |= {item} - {None}
        for length in {min(ngram, int(c)) for c in w.count()} - {0}:
            at, h = w.windows(length)
            whole = np.minimum(w.count()[w.text[at]], ngram) == length
            hashes[length] = np.unique(h[whole])
        self.hashes = dict(hashes)

    def hits(self, w: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, length, items) of every occurrence."""
        out = []
        for length, known in self.hashes.items():
            at, h = w.windows(length)
            near = np.flatnonzero(self._near(known)[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
            for i in at[near[known[place] == h[near]]]:
                found = self.items.get(phrase(w, int(i), length))
                if found is not None:
                    out.append((int(i), length, found))
        return out

    @staticmethod
    def _near(known: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return seen


def phrase(w: Words, at: int, length: int) -> bytes:
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes().lower() for i in range(at, at + length))


def char_at(w: Words, k: int, place: np.ndarray) -> np.ndarray:
    """Code points of text k before each byte offset."""
    own = w.data[w.text_at[k] : w.text_at[k + 1]]
    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
    return points[place - w.text_at[k]]


def _found(texts: pa.Array, windows: WindowSet) -> list[pa.Array]:
    w = words_of(texts, ALNUM, True)
    change = np.zeros(len(w.hash) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for at, length, found in windows.hits(w):
        change[at] += 1
        change[at + length] -= 1
        items[w.text[at]] |= found
    hit = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    spans: list[list[int]] = [[] for _ in range(len(texts))]
    for k in np.unique(w.text[hit]):
        own = hit[w.first[k] : w.first[k + 1]]
        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1) + w.first[k], np.flatnonzero(edge == -1) + w.first[k] - 1
        spans[k] = np.stack([char_at(w, k, w.start[a]), char_at(w, k, w.end[b])], 1).ravel().tolist()
    return [
        pa.array(w.count(), pa.int64()),
        pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.int64())),
    ]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    ngram: int = NGRAM,
    keep: list[str] | None = None,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """`row` and `found`: n_words, n_hit (words inside occurrences), items (sorted ids), spans.

    `spans` holds start and end code points of the hit runs, one after another.
    """
    given = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n_words = given.select(F.sum(F.size(F.split(F.translate("text", UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    if n_words > broadcast_windows:
        return _scan_by_join(docs, given, ngram, keep)
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in given.distinct().collect()], ngram))
    return per_text(docs, "text", keep, FOUND, lambda: lambda texts: _found(texts, windows.value))


def _words(column: str) -> F.Column:
    return F.filter(F.split(F.translate(column, UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda x: x != "")


def _windows(words: F.Column, length: F.Column) -> F.Column:
    n = F.size(words) - length
    return F.when(
        (length > 0) & (n >= 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice(words, i + 1, length)).alias("window")))
    )


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, ngram: int, keep: list[str] | None) -> DataFrame:
    """For a benchmark of any size: windows meet in a join, and hit runs come back by the text's digest."""
    items = benchmark.withColumn("words", _words("text")).where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(ngram)))
    known = items.select("item_id", "length", F.inline(_windows(F.col("words"), F.col("length")))).groupBy("length", "window").agg(F.collect_set("item_id").alias("ids"))
    known = materialise(known, "windows")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())
    texts = docs.select(F.sha2(F.col("text").cast("string"), 256).alias("digest"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").dropDuplicates(["digest"])
    texts = texts.withColumn("words", _words("text"))
    hits = None
    for length in lengths:
        own = texts.select("digest", F.inline(_windows(F.col("words"), F.lit(length)))).withColumn("length", F.lit(length))
        own = own.join(known, ["length", "window"]).select("digest", "at", "length", "ids")
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        hits = texts.select("digest", F.lit(0).alias("at"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("ids")).limit(0)
    by_text = hits.groupBy("digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        F.array_sort(F.collect_set(F.struct("at", "length"))).alias("runs"),
    )
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"), F.sha2(F.col("text").cast("string"), 256).alias("digest"))
    rows = rows.join(by_text, "digest", "left").select(F.struct("row", "items", "runs").alias("given"), "text")

    def run(batches):
        for batch in batches:
            given = batch.column("given")
            w = words_of(batch.column("text"), ALNUM, True)
            runs, n_hit, spans = given.field("runs").to_pylist(), [], []
            for k, own in enumerate(runs):
                hit = np.zeros(int(w.first[k + 1] - w.first[k]) + 2, np.int8)
                for x in own or []:
                    hit[1 + x["at"] : 1 + x["at"] + x["length"]] = 1
                edge = np.diff(hit)
                a, b = np.flatnonzero(edge == 1) + w.first[k], np.flatnonzero(edge == -1) + w.first[k] - 1
                n_hit.append(int(hit.sum()))
                spans.append(np.stack([char_at(w, k, w.start[a]), char_at(w, k, w.end[b])], 1).ravel().tolist() if len(a) else [])
            ids = [x or [] for x in given.field("items").to_pylist()]
            made = pa.StructArray.from_arrays([pa.array(w.count(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], FOUND.fieldNames())
            yield pa.RecordBatch.from_arrays([given.field("row"), made], ["row", "found"])

    return rows.mapInArrow(run, T.StructType([rows.schema["given"].dataType["row"], T.StructField("found", FOUND)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "documents", max_hit_share: float = 0.0, ngram: int = NGRAM) -> DataFrame:
    """The documents without what the benchmark holds; columns stay as they are.

    action "documents" drops documents whose share of hit words is above `max_hit_share`;
    "spans" keeps every document and cuts the hit runs out of its text.
    """
    found = scan(docs, benchmark, ngram=ngram)
    if action == "documents":
        return found.where(~(F.col("found.n_hit") > max_hit_share * F.col("found.n_words"))).select("row.*")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    text, spans = F.col("row.text").cast("string"), F.col("found.spans")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.filter(spans, lambda x, i: i % 2 == 1))
    ends = F.concat(F.filter(spans, lambda x, i: i % 2 == 0), F.array(F.length(text).cast("bigint")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    cut = F.when(F.col("found.n_hit") > 0, kept).otherwise(text)
    return found.select(*[(cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
