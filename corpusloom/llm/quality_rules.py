"""Quality rules: statistics of single texts, and lines that too many documents of a host share.

Words are `[^\\x20\\x09-\\x0D]+`. A line is hashed without its case and spacing. For each host (null: "")
it counts once for each different text that holds it, so that copies of one document count as one. A line is frequent if that
count is `min_docs` at least and above `max_share` of the host's different texts, or `many_docs` at least. Frequent
lines go from the text. A document is depleted if they leave less than `min_left` of its word characters.

Null and empty texts have no words and fail the base rules; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NONSPACE, materialise, per_text, slices, words_of

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.08, 0.2
#: Texts of a host that make a line frequent whatever their share.
MANY_DOCS = 1000
#: Frequent lines (8 bytes each, of all hosts) up to which they are broadcast.
BROADCAST_LINES = 200_000

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, "n_frequent_lines", "frequent_chars")] + [T.StructField("text", T.StringType())])
HELD = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("lines", T.ArrayType(T.LongType()))])


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _hash(raw: bytes) -> tuple[int, int] | None:
    """Hash and word characters of a line; None without words."""
    words = raw.split()
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63), len(b"".join(words).decode("utf-8", "replace"))


def _held(texts: pa.Array) -> list[pa.Array]:
    """Digest of each text and its different lines."""
    whole = [(x or "").encode() for x in texts.to_pylist()]
    lines = [list({h[0] for raw in text.split(b"\n") if (h := _hash(raw))}) for text in whole]
    return [pa.array([xxhash.xxh3_128_digest(x) for x in whole], pa.binary()), pa.array(lines, pa.list_(pa.int64()))]


def _without(text: str | None, frequent) -> tuple[int, int, int, str | None]:
    """Repeated lines, different frequent lines, their word characters, and the text without them."""
    seen: set[bytes] = set()
    lost: set[int] = set()
    repeated, chars, left = 0, 0, []
    for raw in (text or "").encode().split(b"\n"):
        found = _hash(raw)
        if found:
            repeated += raw in seen
            seen.add(raw)
            if found[0] in frequent:
                lost.add(found[0])
                chars += found[1]
                continue
        left.append(raw)
    return repeated, len(lost), chars, None if text is None else b"\n".join(left).decode() if lost else text


def _found(texts: pa.Array, frequent: list) -> list[pa.Array]:
    w = words_of(texts, NONSPACE, False)
    points = ((w.data & 0xC0) != 0x80) & NONSPACE[w.data]
    at, h = w.windows(WINDOW)
    key = h + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    repeats = _sums(np.cumsum(change[:-1]) > 0, w.first)
    dup, n_lost, lost, left = zip(*map(_without, texts.to_pylist(), frequent), strict=True)
    numbers = (w.count(), _sums(points, w.text_at), _sums(_SYMBOLS[w.data], w.text_at), dup, repeats, n_lost, lost)
    return [*[pa.array(x, pa.int64()) for x in numbers], pa.array(left, pa.string())]


def apply_rules(
    docs: DataFrame,
    *,
    host: str = "source",
    keep: list[str] | None = None,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    many_docs: int = MANY_DOCS,
    broadcast_lines: int = BROADCAST_LINES,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """`row`, the base columns, n_frequent_lines, frequent_chars, `text` without frequent lines, base_failed and kept."""
    # the host is part of the row, whether kept or not
    names = list(dict.fromkeys([*(docs.columns if keep is None else keep), host]))
    own = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), own, F.col("text").cast("string").alias("text"))
    held = per_text(given, "text", ["host"], HELD, lambda: _held).select("row.host", "found.*")
    texts = materialise(held.groupBy("host", "digest").agg(F.first("lines").alias("lines")), "lines")
    lines = texts.select("host", "digest", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    often = (F.col("n_docs") > max_share * F.col("n_host")) | (F.col("n_docs") >= many_docs)
    frequent = materialise(counts.join(totals, "host").where(often).select("host", "line"), "frequent")
    if frequent.count() <= broadcast_lines:
        found: dict[str, set[int]] = {}
        for r in frequent.collect():
            found.setdefault(r[0], set()).add(r[1])
        sent = docs.sparkSession.sparkContext.broadcast(found)
        given = given.withColumn("drop", F.lit(None).cast("array<long>"))
    else:
        # a text's frequent lines come to it by its digest
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [xxhash.xxh3_128_digest((x or "").encode()) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "digest"])

        sent = None
        lost = lines.join(frequent, ["host", "line"]).groupBy("host", "digest").agg(F.collect_set("line").alias("drop"))
        keyed = given.mapInArrow(digests, T.StructType([*given.schema.fields, T.StructField("digest", T.BinaryType())]))
        given = keyed.join(lost, ["host", "digest"], "left").select("row", "host", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                drop = [sent.value.get(h, ()) for h in part.column("host").to_pylist()] if sent else [set(x or ()) for x in part.column("drop").to_pylist()]
                made = pa.StructArray.from_arrays(_found(part.column("text"), drop), FOUND.fieldNames())
                yield pa.RecordBatch.from_arrays([part.column("row"), made], ["row", "found"])

    out = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("found", FOUND)])).select("row", "found.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("word_chars") - F.col("frequent_chars") < min_left * F.col("word_chars")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})

