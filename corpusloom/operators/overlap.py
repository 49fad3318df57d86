"""Rows that hold most words of many lists of words: counted and ranked in the tasks that read the rows, so only the best leave them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Counts, and words met, that a task holds at a time.
COUNTS = 1 << 21


class _Best:
    """The n best rows so far of each list: most words, then by key (null first), then by hash; repeated rows are one."""

    def __init__(self, lists: list[list[str]], n: int):
        self.n, self.lists = n, len(lists)
        place: dict[str, int] = {}
        word = np.array([place.setdefault(w, len(place)) for own in lists for w in own], np.int64)
        self.vocabulary = pa.array(list(place), pa.string())
        # lists by word
        self.of = np.repeat(np.arange(self.lists), [len(own) for own in lists])[np.argsort(word, kind="stable")]
        self.size = np.bincount(word, minlength=len(place))
        self.start = np.cumsum(self.size) - self.size
        # what is kept: list, count, and row, a place in `rows`
        self.rows: list[tuple] = []
        self.kept, self.pending = np.zeros((0, 3), np.int64), []
        # the count that a list's n-th row has, and the row; 0 and none before there are n
        self.least, self.last = np.zeros(self.lists, np.int64), [None] * self.lists

    def add(self, keys: list, hashes: list[int], words: pa.ListArray) -> None:
        index = pc.index_in(words.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
        owner, index = owner[index >= 0], index[index >= 0]
        met = np.cumsum(np.bincount(owner, self.size[index], len(words)).astype(np.int64))
        step, a = max(1, COUNTS // self.lists), 0
        while a < len(words):
            before = met[a - 1] if a else 0
            b = max(a + 1, min(a + step, int(np.searchsorted(met, before + COUNTS, "right"))))
            s, e = np.searchsorted(owner, [a, b])
            own, reps = index[s:e], self.size[index[s:e]]
            places = np.repeat(self.start[own] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            cells = np.repeat(owner[s:e] - a, reps) * self.lists + self.of[places]
            self._take(np.bincount(cells, minlength=(b - a) * self.lists).reshape(b - a, self.lists), [(k is not None, k, h) for k, h in zip(keys[a:b], hashes[a:b], strict=True)])
            a = b

    def _take(self, counts: np.ndarray, rows: list[tuple]) -> None:
        first: dict[tuple, int] = {}
        for i, r in enumerate(rows):
            first.setdefault(r, i)
        place = {r: i for i, r in enumerate(sorted({*first, *(r for r in self.last if r is not None)}))}
        rank = np.array([place[r] for r in rows])
        bar = np.array([-1 if r is None else place[r] for r in self.last])
        # of as many words, those before the last kept one
        better = (counts > self.least) | ((counts == self.least) & (rank[:, None] < bar))
        better[np.setdiff1d(np.arange(len(rows)), np.fromiter(first.values(), np.int64))] = False
        many = np.flatnonzero(better.sum(0) > 4 * self.n)
        if len(many):
            order = np.where(better[:, many], counts[:, many] * len(place) + (len(place) - 1 - rank)[:, None], -1)
            top = np.argpartition(-order, self.n - 1, axis=0)[: self.n]
            chosen = np.zeros((len(rows), len(many)), bool)
            chosen[top, np.arange(len(many))] = True
            better[:, many] &= chosen
        i, j = np.nonzero(better)
        if len(i):
            used, where = np.unique(i, return_inverse=True)
            self.pending.append(np.stack([j, counts[i, j], where + len(self.rows)], 1))
            self.rows += [rows[x] for x in used]
            if sum(map(len, self.pending)) > self.lists * self.n // 4 + 1024:
                self._keep()

    def _keep(self) -> None:
        every = np.concatenate([self.kept, *self.pending])
        self.pending = []
        if not len(every):
            return
        ordered = sorted({self.rows[i] for i in np.unique(every[:, 2])})
        place = {r: i for i, r in enumerate(ordered)}
        every[:, 2] = np.array([place.get(r, -1) for r in self.rows])[every[:, 2]]
        every = every[np.lexsort((every[:, 2], -every[:, 1], every[:, 0]))]
        every = every[np.r_[True, (every[1:, [0, 2]] != every[:-1, [0, 2]]).any(1)]]
        new = np.r_[True, every[1:, 0] != every[:-1, 0]]
        at = np.arange(len(every)) - np.maximum.accumulate(np.where(new, np.arange(len(every)), 0))
        self.kept, self.rows = every[at < self.n], ordered
        for j, n, i in every[at == self.n - 1].tolist():
            self.least[j], self.last[j] = n, ordered[i]
        used, where = np.unique(self.kept[:, 2], return_inverse=True)
        self.rows, self.kept[:, 2] = [ordered[i] for i in used], where

    def best(self) -> tuple[np.ndarray, list[tuple]]:
        self._keep()
        return self.kept, self.rows


def most_words(lists: list[tuple[int, list[str]]], rows: DataFrame, n: int) -> DataFrame:
    """(no, count, key, hash): rows (key, hash, words: different ones) that hold most words of each list (no, different words), of each task n, ties by key, then hash; none that holds none."""
    key_type = rows.schema["key"].dataType
    out = T.StructType([T.StructField("no", T.LongType()), T.StructField("count", T.LongType()), T.StructField("key", key_type), T.StructField("hash", T.LongType())])
    numbers = np.array([no for no, _ in lists], np.int64)
    words = [own for _, own in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            return
        best, kind = _Best(words, n), None
        for batch in batches:
            kind = batch.schema.field("key").type
            best.add(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), batch.column("words"))
        kept, found = best.best()
        for a in range(0, len(kept), 1 << 16):
            part = kept[a : a + (1 << 16)]
            own = [found[i] for i in part[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[part[:, 0]]), pa.array(part[:, 1]), pa.array([r[1] for r in own], kind), pa.array([r[2] for r in own], pa.int64())], ["no", "count", "key", "hash"])

    return rows.select("key", "hash", "words").mapInArrow(run, out)
