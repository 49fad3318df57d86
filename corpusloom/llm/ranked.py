"""Ranked lexical search by a length-stratified index.

Terms are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of whole texts, A-Z lower-cased. Documents of equal
normaliser m form a stratum, dealt by ranges of (m, doc_id) and cut into segments; a segment is a row with its
terms' dictionary and, term by term, postings grouped by their number of occurrences tf. As m is one number for
a whole segment, an impact is computed once for each tf that occurs in it, not once a posting.

A search broadcasts a block of items (BLOCK_ITEMS of them at most, BLOCK_TERMS different terms) against all segments, three
times: document frequencies from the dictionaries; bounds of each stratum (the impacts of its terms' largest tf),
which order visits: the strata of the highest bounds are visited first and give each item a threshold; then every
segment whose bound reaches the threshold, which rises further as the visits go on. Postings of other segments are not touched;
a bound is never below a score, so nothing is lost.

Null and empty texts and texts without a term are in no stratum. Repeated documents are ranked one by one; equal
scores go by ascending doc_id, null ids last. Each row of the items is ranked on its own, repeated ones too; an item
without terms, or without a document that scores above 0, gives no row. An empty table gives no rows. A text is indexed whole, however
long it is; a task holds one text, or a slice of shorter ones, at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, give_back, settings, slices
from .workspace import Workspace

#: Different terms of each document, added up, and documents of a segment, at most; what one document has beyond that is not cut.
SEGMENT_TERMS, SEGMENT_DOCS = 1 << 17, 1 << 16
#: Items and different terms that are broadcast at a time.
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
#: Strata of the highest bounds that are visited for an item's first threshold.
FIRST = 16
#: Scores that are held at a time: items by documents of a segment.
HELD_SCORES = 1 << 21
#: Settings of a build and a search: a segment is a large row, so few of them are decoded, and go to Python, at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "32"}

_NO_ID = np.iinfo(np.int64).max

FORWARD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
SEGMENT = T.StructType(
    [
        T.StructField("m", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        # by term: documents that hold it, its largest tf, its groups of equal tf
        T.StructField("dfs", T.BinaryType()),
        T.StructField("max_tfs", T.BinaryType()),
        T.StructField("group_counts", T.BinaryType()),
        # by group: tf and documents; then all documents, by their place in doc_ids
        T.StructField("group_tfs", T.BinaryType()),
        T.StructField("group_sizes", T.BinaryType()),
        T.StructField("places", T.BinaryType()),
    ]
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms in each text, and all terms one after the other."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    at = offsets - lo
    inside = ALNUM[data]
    step = np.ones(len(data) + 1, bool)
    step[1:-1] = inside[1:] != inside[:-1] if len(data) else []
    # texts end words, too
    step[at] = True
    edges = np.flatnonzero(step)
    runs = inside[edges[:-1]]
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(low)])
    counts = np.diff(np.searchsorted(edges[:-1][runs], at))
    return counts, parts.filter(pa.array(runs))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of terms, and its different terms with their numbers of occurrences."""
    for batch in batches:
        for part in slices(batch):
            counts, terms = terms_of(part.column("text"))
            coded = terms.dictionary_encode()
            size = max(1, len(coded.dictionary))
            keys, tfs = np.unique(np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            doc, term = np.divmod(keys, size)
            at = np.searchsorted(doc, np.arange(len(counts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), coded.dictionary.cast(pa.string()).take(pa.array(term)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tfs, pa.int32()))], FORWARD.fieldNames())


def _segment(m: int, doc_ids: list[int | None], counts: np.ndarray, terms: pa.Array, tfs: np.ndarray) -> list[pa.Array]:
    """counts: different terms of each document; terms, tfs: those of one document after the other."""
    coded = terms.dictionary_encode()
    term, place, size = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts), len(coded.dictionary)
    order = np.lexsort((place, -tfs, term))
    term, place, tfs = term[order], place[order], tfs[order]
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_group = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tfs, prepend=-1) != 0))
    ends = lambda starts: np.diff(np.append(starts, len(term)))
    packed = lambda x, kind="<u4": pa.array([x.astype(kind).tobytes()], pa.binary())
    return [
        pa.array([m], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), coded.dictionary),
        packed(ends(new_term)),
        packed(tfs[new_term]),
        packed(np.bincount(term[new_group], minlength=size)),
        packed(tfs[new_group]),
        packed(ends(new_group)),
        packed(place, "<u2"),
    ]


def _segments(batches: Iterator[pa.RecordBatch], most_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc_id, terms, tfs), sorted by m, as segments."""
    own, ids, parts, held = None, [], [], 0

    def flush() -> pa.RecordBatch:
        sizes, terms, tfs = zip(*parts, strict=True)
        return pa.RecordBatch.from_arrays(_segment(own, ids, np.concatenate(sizes), pa.concat_arrays(terms), np.concatenate(tfs)), SEGMENT.fieldNames())

    for batch in batches:
        ms, doc_ids, at = batch.column("m").to_numpy(), batch.column("doc_id").to_pylist(), 0
        terms, tfs = batch.column("terms"), batch.column("tfs")
        ends = terms.offsets.to_numpy().astype(np.int64)
        while at < len(ms):
            if ids and (ms[at] != own or held >= most_terms or len(ids) >= SEGMENT_DOCS):
                yield flush()
                ids, parts, held = [], [], 0
            own = int(ms[at])
            same = at + int(np.searchsorted(ms[at:], own, side="right"))
            room = int(np.searchsorted(ends, ends[at] + most_terms - held, side="right")) - 1
            to = max(at + 1, min(same, room, at + SEGMENT_DOCS - len(ids)))
            ids += doc_ids[at:to]
            parts.append((np.diff(ends[at : to + 1]), terms.slice(at, to - at).flatten(), tfs.slice(at, to - at).flatten().to_numpy()))
            held += int(ends[to] - ends[at])
            at = to
        give_back()
    if ids:
        yield flush()


@dataclass
class Index:
    """Segments under a path, with the numbers of documents and terms that weights and strata stand on."""

    segments: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, path: str, work: Workspace, *, id: str = "doc_id", text: str = "text", segment_terms: int = SEGMENT_TERMS) -> Index:
    """Write the index of every whole text of `docs` under `path`; `work` holds what is between."""
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    forward = work.store(given.mapInArrow(_forward, FORWARD), "forward", compression="zstd").where("n > 0")
    count = forward.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    m = F.expr(f"{100 - 50} + (50 * n * {count.documents}) div {max(1, count.terms)}").cast("bigint")
    # ranges split a stratum that holds many documents, also those of one doc_id
    dealt = forward.withColumn("m", m).repartitionByRange("m", "doc_id", F.xxhash64("terms")).sortWithinPartitions("m", "doc_id")
    segments = dealt.select("m", "doc_id", "terms", "tfs").mapInArrow(functools.partial(_segments, most_terms=segment_terms), SEGMENT)
    with settings(spark, {c: v for c, v in FEW_ROWS.items() if "arrow" in c}):
        # few segments make a row group, too
        segments.write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(SEGMENT).parquet(path), int(count.documents), int(count.terms))


@dataclass
class _Block:
    """Items of a block as rows of a sparse matrix: item -> its terms, and the terms' weights."""

    ids: list
    at: np.ndarray
    term: np.ndarray
    terms: pa.Array
    weights: np.ndarray | None = None


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[_Block]:
    rows, seen = [], {}

    def made() -> _Block:
        at = np.cumsum([0, *(len(t) for _, t in rows)])
        return _Block([i for i, _ in rows], at, np.array([x for _, t in rows for x in t], np.int64), pa.array(list(seen), pa.string()))

    for item, body in items.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).toLocalIterator():
        own = list(dict.fromkeys(terms_of(pa.array([body], pa.string()))[1].to_pylist()))
        if rows and (len(rows) >= BLOCK_ITEMS or len(seen) + len(own) > BLOCK_TERMS):
            yield made()
            rows, seen = [], {}
        rows.append((item, [seen.setdefault(t, len(seen)) for t in own]))
    if rows:
        yield made()


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _rows(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each segment's columns, with the places in its dictionary of the terms asked for, and their numbers."""
    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            own = batch.column(names.index("terms"))[row].values
            number = pc.index_in(own, value_set=terms)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                segment = {c: batch.column(i)[row] for i, c in enumerate(names)}
                yield segment, np.flatnonzero(known), number.drop_null().to_numpy().astype(np.int64)
        give_back()


def _uint(value: pa.Scalar, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _frequencies(index: Index, block: _Block) -> np.ndarray:
    """Documents that hold each term of the block."""
    terms = block.terms

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for segment, place, number in _rows(batches, terms):
            total[number] += _uint(segment["dfs"])[place]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    found = index.segments.select("terms", "dfs").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _bounds(segment: dict, place: np.ndarray, number: np.ndarray, block: _Block) -> np.ndarray:
    """The most that a document of the segment can score, by item."""
    best = np.zeros(len(block.terms), np.int64)
    best[number] = impact(_uint(segment["max_tfs"])[place], segment["m"].as_py()) * block.weights[number]
    ends = np.concatenate([[0], np.cumsum(best[block.term])])[block.at]
    return np.diff(ends)


def _first(index: Index, block: _Block) -> dict[int, set[int]]:
    """Strata (m) to visit first, with the items that want them: those of each item's highest bounds."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for segment, place, number in _rows(batches, block.terms):
            m, own = segment["m"].as_py(), _bounds(segment, place, number, block)
            found[m] = np.maximum(found[m], own) if m in found else own
            if len(found) >= 4 * FIRST:
                found = _highest(found)
        rows = [(i, m, int(b)) for m, own in _highest(found).items() for i, b in enumerate(own) if b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "m", "bound"])

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "m"))
    strata = index.segments.select("m", "terms", "max_tfs").mapInArrow(run, "item bigint, m bigint, bound bigint").groupBy("item", "m").agg(F.max("bound").alias("bound"))
    out: dict[int, set[int]] = {}
    for item, m in strata.withColumn("k", rank).where(F.col("k") <= FIRST).select("item", "m").collect():
        out.setdefault(m, set()).add(item)
    return out


def _highest(found: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of the strata, each item's FIRST highest bounds; the others become 0, or go."""
    if len(found) <= FIRST:
        return found
    ms, table = list(found), np.array(list(found.values()))
    least = np.partition(table, -FIRST, axis=0)[-FIRST]
    table[table < least] = 0
    return {m: own for m, own in zip(ms, table, strict=True) if own.any()}


def _scores(segment: dict, place: np.ndarray, number: np.ndarray, block: _Block, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores of all documents of a segment for some items at a time: (items, one row an item)."""
    groups = _uint(segment["group_counts"]).astype(np.int64)
    group_at = np.concatenate([[0], np.cumsum(groups)])
    sizes, tfs = _uint(segment["group_sizes"]).astype(np.int64), _uint(segment["group_tfs"])
    at = np.concatenate([[0], np.cumsum(sizes)])
    # once a tf, then once a group
    levels, level = np.unique(tfs, return_inverse=True)
    by_group = impact(levels, segment["m"].as_py())[level]
    places, n = _uint(segment["places"], "<u2"), len(segment["doc_ids"])
    slot = np.full(len(block.terms), -1, np.int64)
    slot[number] = place
    width = max(1, HELD_SCORES // max(1, n))
    for first in range(0, len(items), width):
        own = items[first : first + width]
        count = block.at[own + 1] - block.at[own]
        pair = np.repeat(block.at[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        row, term = np.repeat(np.arange(len(own)), count), block.term[pair]
        there = slot[term] >= 0
        row, term = row[there], term[there]
        total = np.zeros(len(own) * n, np.int64)
        entry = slot[term]
        ends = at[group_at[entry + 1]] - at[group_at[entry]]
        done = 0
        while done < len(entry):
            # about HELD_SCORES postings at a time
            to = max(done + 1, done + int(np.searchsorted(np.cumsum(ends[done:]), HELD_SCORES, side="right")))
            size = ends[done:to]
            posting = np.repeat(at[group_at[entry[done:to]]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            value = by_group[np.searchsorted(at, posting, side="right") - 1] * np.repeat(block.weights[term[done:to]], size)
            cell = np.repeat(row[done:to] * n, size) + places[posting]
            # sums of two halves of the bits stay exact in doubles
            high, low = value >> 24, value & ((1 << 24) - 1)
            total += (np.bincount(cell, high, len(total)).astype(np.int64) << 24) + np.bincount(cell, low, len(total)).astype(np.int64)
            done = to
        yield own, total.reshape(len(own), n)


class _Best:
    """The k best documents of each item so far: highest score, then lowest id."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), _NO_ID, np.int64)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        own = np.flatnonzero(scores >= max(1, self.least[item]))
        if not len(own):
            return
        score, doc = np.append(self.score[item], scores[own]), np.append(self.doc[item], docs[own])
        order = np.lexsort((doc, -score))[: self.k]
        self.score[item], self.doc[item] = score[order], doc[order]
        self.least[item] = max(self.least[item], self.score[item, -1])


def _visit(index: Index, block: _Block, k: int, least: np.ndarray, first: dict[int, set[int]], seed: bool) -> DataFrame:
    """(item, doc_id, score): candidates from the strata of `first` (seed), or from all others that can reach `least`."""
    n_items = len(block.ids)

    def run(batches):
        best = _Best(n_items, k, least)
        for segment, place, number in _rows(batches, block.terms):
            asked, m = _bounds(segment, place, number, block), segment["m"].as_py()
            want = (asked > 0) & (asked >= best.least)
            chosen = np.zeros(n_items, bool)
            chosen[list(first.get(m, ()))] = True
            items = np.flatnonzero(want & (chosen if seed else ~chosen))
            if not len(items):
                continue
            docs = segment["doc_ids"].values.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for own, table in _scores(segment, place, number, block, items):
                for item, scores in zip(own.tolist(), table, strict=True):
                    best.add(item, scores, docs)
        item, at = np.nonzero(best.score)
        doc = best.doc[item, at]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == _NO_ID), pa.array(best.score[item, at])], ["item", "doc_id", "score"])

    segments = index.segments
    if seed:
        segments = segments.where(F.col("m").isin(list(first)))
    return segments.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(index: Index, items: DataFrame, k: int, work: Workspace, *, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by blocks of items."""
    with settings(items.sparkSession, FEW_ROWS):
        return _search(index, items, k, work, id, text)


def _search(index: Index, items: DataFrame, k: int, work: Workspace, id: str, text: str) -> DataFrame:
    spark: SparkSession = items.sparkSession
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    kind = items.schema[id].dataType
    out = T.StructType([T.StructField(id, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = []
    for no, block in enumerate(_blocks(items, id, text)):
        df = _frequencies(index, block)
        block.weights = np.array([np.floor(1000 * np.log((2 * index.documents + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64).reshape(len(df))
        first = _first(index, block)
        nothing = np.zeros(len(block.ids), np.int64)
        seeds = work.store(_visit(index, block, k, nothing, first, True).withColumn("k", rank).where(F.col("k") <= k).drop("k"), f"seeds-{no}")
        least = nothing.copy()
        for item, n, score in seeds.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score")).collect():
            least[item] = score if n >= k else 0
        rest = _visit(index, block, k, least, first, False)
        best = rest.unionByName(seeds).withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField(id, kind)]))
        # BLOCK_ITEMS rows at most
        found.append(work.store(best.join(F.broadcast(names), "item").select(id, "rank", "doc_id", "score"), f"found-{no}"))
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)


def rank(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Index `docs`, search all `items`, and remove the index."""
    with Workspace(docs.sparkSession, "ranked") as work:
        index = build(docs, work.path("segments"), work)
        return work.result(search(index, items, k, work))
