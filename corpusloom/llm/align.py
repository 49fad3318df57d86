"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Both tokenizers read a space and the text. Where white space follows other characters, no token of either reaches
across (`Pair` looks through the vocabularies), so texts are cut into units there, and a worker keeps the ids of units
it has seen. The merge itself runs over whole batches: one state vector holds a pointer into the A tokens and one
into the B tokens of every run (a document, or RUN units of a longer one); each step emits the links of all current
pairs, a cut where both tokens end, moves on whichever ends first, and drops the runs that are done.

`align` gives each text's counts, its groups as text and its different linked id pairs; `pair_counts` how many
documents hold each pair; `score` what a document's links count. Pairs are numbers A id * B vocabulary + B id, so there
are at most as many as the product of both vocabularies, however large the corpus; counts are broadcast in
ranges of RANGE_PAIRS, one pass over the packed pairs each, so no worker holds more.

Null and empty texts, and texts whose joined A or B bytes are not the space and the text (U+2581 in it), have no
tokens: zeros, and ''. Repeated rows are documents of their own, also in the counts. An empty table gives no rows.
Texts are read whole; a task holds a slice of 2 MB of them, or one longer text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _BYTE_LETTERS
from .common import give_back, slices
from .workspace import Workspace

SLICE = 1 << 21
#: Units and their ids that a worker remembers; it starts anew beyond that.
CACHE, CACHE_IDS = 200_000, 4_000_000
#: Units of a run of the state vector.
RUN = 64
#: Pairs whose counts are broadcast at a time (13 bytes each).
RANGE_PAIRS = 2_000_000
#: Different pairs that a task adds up before it passes them on.
HELD_PAIRS = 1 << 21


class Pair:
    """Two tokenizers (A: a file of the tokenizers library, byte-level; B: a sentencepiece model) and the units seen."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {chr(letter): byte for byte, letter in _BYTE_LETTERS.items()}
        spelled = lambda token: bytes(letters.get(c, ord(c) & 255) for c in token)
        self.bytes_a = [spelled(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        self.lone = self.b.piece_to_id("▁")
        #: What units rely on: no B piece holds a space after anything else, a line feed or a tab; A splits at white space.
        self.by_units = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any(re.search("[^▁]▁|[ \n\t]", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.good = array("b")
        self.flat_a, self.first_a, self.flat_b, self.first_b = array("i"), array("q", [0]), array("i"), array("q", [0])

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        coded_a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        # B puts a space before what it gets: the unit's own first one, or one that goes again
        spaced = [t.startswith(" ") for t in texts]
        coded_b = self.b.encode([t[1:] if s else t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        for unit, own, a, b in zip(units, spaced, coded_a, coded_b, strict=True):
            if own and len(unit) == 1:
                b = [self.lone]
            elif not own:
                b = b[1:] if b and b[0] == self.lone else [0]
            self.index[unit] = len(self.good)
            self.good.append(b"".join(map(self.bytes_a.__getitem__, a)) == unit == b"".join(map(self.bytes_b.__getitem__, b)))
            self.flat_a.extend(a)
            self.first_a.append(len(self.flat_a))
            self.flat_b.extend(b)
            self.first_b.append(len(self.flat_b))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(first unit of each text, A ids, first A id of each unit, B ids, first B id of each unit); no units where there are no tokens."""
        known = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        text = lambda x: pa.scalar(x, pa.large_string())
        spaced = pc.if_else(known, pc.binary_join_element_wise(text(" "), texts.cast(pa.large_string()).fill_null(""), text("")), text(""))
        n = len(spaced)
        at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + n + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[int(at[0]) : int(at[-1])] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        starts = cuts(data, at) if self.by_units else np.unique(at[:-1][np.diff(at) > 0])
        edges = np.append(starts, len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.good) > CACHE or len(self.flat_a) > CACHE_IDS:
            self._forget()
        if new := [u for u in different if u not in self.index]:
            self._learn(new)
        own = np.array([self.index[u] for u in different], np.int64)[coded.indices.to_numpy()] if different else np.zeros(0, np.int64)
        first = np.searchsorted(starts, at)
        bad = np.frombuffer(self.good, np.int8)[own] == 0
        if bad.any():
            text = np.repeat(np.arange(n), np.diff(first))
            lost = np.zeros(n, bool)
            lost[text[bad]] = True
            own, text = own[~lost[text]], text[~lost[text]]
            first = np.searchsorted(text, np.arange(n + 1))

        def flat(ids: array, ends: array) -> tuple[np.ndarray, np.ndarray]:
            ends = np.frombuffer(ends, np.int64)
            size = ends[own + 1] - ends[own]
            unit_at = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(ends[own] - unit_at[:-1], size) + np.arange(unit_at[-1])
            return (np.frombuffer(ids, np.int32)[place] if len(place) else np.zeros(0, np.int32)), unit_at

        return first, *flat(self.flat_a, self.first_a), *flat(self.flat_b, self.first_b)


def cuts(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where units start: at a text's start, and at a space, tab or line feed after what is surely no white space
    (ASCII, or a letter of two bytes: U+0085 and U+00A0 begin with C2)."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = (data == 32) | (data == 10) | (data == 9)
    solid = (data > 32) & (data < 127)
    solid[1:] |= (data[1:] >= 128) & (data[1:] < 192) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & solid[:-1]
    cut[text_at[:-1][np.diff(text_at) > 0]] = True
    return np.flatnonzero(cut)


def merge(run_a: np.ndarray, run_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A tokens, B tokens) and cuts (last A token, last B token of each group) of all runs at once.

    run_a, run_b: first token of each run, and the number of all tokens at their end; end_a, end_b: bytes up to
    the end of each token. Both sides of a run cover the same bytes.
    """
    some = run_a[1:] > run_a[:-1]
    i, j, stop = run_a[:-1][some], run_b[:-1][some], run_a[1:][some]
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        a, b = end_a[i], end_b[j]
        both = a == b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        i, j = i + (a <= b), j + (b <= a)
        left = i < stop
        if not left.all():
            i, j, stop = i[left], j[left], stop[left]
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(links_a), joined(links_b), joined(cuts_a), joined(cuts_b)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-aligned, and how many they are."""
    text = np.char.ljust(np.arange(n).astype(str), 10)
    return np.frombuffer("".join(text).encode(), np.uint8).reshape(n, 10), np.array([len(str(x)) for x in range(n)], np.int64)


def _spell(ids_a, ids_b, cut_a: np.ndarray, cut_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, digits: tuple) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of each document; cut_a, cut_b: whether a token ends its group; doc_a, doc_b: first tokens of documents."""
    table, size = digits
    n_a, n_b = len(ids_a), len(ids_b)
    ends_a, ends_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    # a token comes after all tokens of earlier groups, a B token after its group's A tokens too
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    order_a = np.arange(n_a) + np.concatenate([[0], ends_b + 1])[group_a] if n_a else np.zeros(0, np.int64)
    order_b = np.arange(n_b) + (ends_a + 1)[group_b] if n_b else np.zeros(0, np.int64)
    ids, mark = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
    ids[order_a], ids[order_b] = ids_a, ids_b
    mark[order_a], mark[order_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    length = size[ids] + 1
    # the last mark of a document goes
    first = doc_a + doc_b
    last = first[1:][np.diff(first) > 0] - 1
    length[last] -= 1
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(int(at[-1]), np.uint8)
    for d in range(int(size.max())):
        own = np.flatnonzero(size[ids] > d)
        out[at[own] + d] = table[ids[own], d]
    marked = np.ones(len(ids), bool)
    marked[last] = False
    out[at[1:][marked] - 1] = mark[marked]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(at[first].astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def _pairs(link_doc: np.ndarray, keys: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Different keys of each document in order, as differences, and how often each is linked; 32 bits each."""
    order = np.lexsort((keys, link_doc))
    doc, key = link_doc[order], keys[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
    times = np.diff(np.append(new, len(doc))).astype("<u4")
    doc, key = doc[new], key[new]
    step = np.diff(key, prepend=0)
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    begin = at[:-1][np.diff(at) > 0]
    step[begin] = key[begin]
    packed = lambda x: pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(x.astype("<u4"))])
    return packed(step), packed(times)


_KEPT: dict[tuple[str, str], Pair] = {}


def pair_for(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers a worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Pair(path_a, path_b)
    return _KEPT[path_a, path_b]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
FOUND = T.StructType([*[T.StructField(c, T.LongType()) for c in _COUNTS], *[T.StructField(c, k) for c, k in (("groups", T.StringType()), ("pairs", T.BinaryType()), ("pair_links", T.BinaryType()))]])


def align(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`row` (the kept columns) and `found`: counts, `groups` (`a1,a2|b1;a3|b2,b3` of the ids), and the different
    linked `pairs` with how often each is linked in the text (both packed)."""
    names = docs.columns if keep is None else list(keep)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def found(pair: Pair, digits: tuple, texts: pa.Array) -> pa.Array:
        first, ids_a, unit_a, ids_b, unit_b = pair.encode(texts)
        n = len(first) - 1
        doc_a, doc_b = unit_a[first], unit_b[first]
        units = np.arange(len(unit_a) - 1)
        starts = np.append(np.flatnonzero((units - np.repeat(first[:-1], np.diff(first))) % RUN == 0), len(units))
        link_a, link_b, last_a, last_b = merge(unit_a[starts], unit_b[starts], np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b]))
        cut_a, cut_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        cut_a[last_a] = cut_b[last_b] = True
        link_doc = np.searchsorted(doc_a, link_a, side="right") - 1
        counts = [np.diff(doc_a), np.diff(doc_b), np.bincount(np.searchsorted(doc_a, last_a, side="right") - 1, minlength=n), np.bincount(link_doc, minlength=n)]
        keys = ids_a[link_a].astype(np.int64) * len(pair.bytes_b) + ids_b[link_b]
        columns = [*(pa.array(c, pa.int64()) for c in counts), _spell(ids_a, ids_b, cut_a, cut_b, doc_a, doc_b, digits), *_pairs(link_doc, keys, n)]
        return pa.StructArray.from_arrays(columns, FOUND.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_for(path_a, path_b)
        digits = _digits(max(len(pair.bytes_a), len(pair.bytes_b)))
        for batch in batches:
            for part in slices(batch, size=SLICE):
                yield pa.RecordBatch.from_arrays([part.column("row"), found(pair, digits, part.column("text"))], ["row", "found"])

    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("found", FOUND)]))


def _unpacked(pairs: pa.Array, times: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(first pair of each document, pairs, links of each)."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return (at - at[0]) // 4, np.frombuffer(column.buffers()[2], "<u4")[at[0] // 4 : at[-1] // 4] if at[-1] > at[0] else np.zeros(0, "<u4")

    at, steps = flat(pairs)
    total = np.cumsum(steps.astype(np.int64))
    before = np.concatenate([[0], total])[at[:-1]]
    keys = total - np.repeat(before, np.diff(at))
    return at, keys, flat(times)[1].astype(np.int64) if times is not None else None


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, n, best): documents that hold each pair, and whether that is the highest of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate([x for x, _ in [(held, 0), *more]]), return_inverse=True)
            return keys, np.bincount(n, np.concatenate([counts, *(c for _, c in more)]), len(keys)).astype(np.int64)

        waiting = 0
        for batch in batches:
            keys, n = np.unique(_unpacked(batch.column("pairs"))[1], return_counts=True)
            more.append((keys, n.astype(np.int64)))
            waiting += len(keys)
            if waiting > HELD_PAIRS:
                held, counts = combined()
                more, waiting = [], 0
                if len(held) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])
                    held, counts = held[:0], counts[:0]
                give_back()
        held, counts = combined()
        for at in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

    n = aligned.select("found.pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.expr(f"pair div {size_b}")
    # an A id has at most size_b pairs
    return n.withColumn("a", a).withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def score(aligned: DataFrame, counts: DataFrame, work: Workspace, *, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """`aligned` (written, as it is read once a range) with `n_best` (links whose count is their A id's highest) and `count_sum`, by `counts` (written)."""
    sizes = counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy("a").collect()  # a row an A id
    ranges, held = [], range_pairs + 1
    for a, n in sizes:
        if held + n > range_pairs:
            ranges.append([a, a])
            held = 0
        ranges[-1][1], held = a, held + n
    numbered = aligned.select("row", "found", F.monotonically_increasing_id().alias("no"))
    if len(ranges) <= 1:
        return _scored(numbered, counts, ["row", "found"])
    numbered = work.store(numbered, "numbered", compression="zstd")
    parts = [_scored(numbered, counts.where(F.col("a").between(lo, hi)), ["no"]) for lo, hi in ranges]
    total = functools.reduce(DataFrame.unionByName, parts).groupBy("no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.join(total, "no").select("row", "found", "n_best", "count_sum")


def _scored(numbered: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """One range of pairs, RANGE_PAIRS of them or those of one A id at most, broadcast."""
    table = counts.select("pair", "n", "best").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    own = [table.column(c).to_numpy()[order] for c in ("pair", "n", "best")]
    sent = numbered.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            at, keys, links = _unpacked(batch.column("pairs"), batch.column("pair_links"))
            place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            there = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            links = np.where(there, links, 0)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in ((links * best[place], links * n[place]) if len(known) else (links, links))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, sums)], [*keep, "n_best", "count_sum"])
            give_back()

    given = numbered.select(*keep, F.col("found.pairs").alias("pairs"), F.col("found.pair_links").alias("pair_links"))
    return given.mapInArrow(run, T.StructType([*[given.schema[c] for c in keep], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
