"""Exact nearest rows of many queries: blocks of rows meet blocks of queries as products of matrices, in tasks that Spark deals out.

Rows lie in cells, and each cell gets every block of queries, so a task holds one block of queries and streams the rows of its cell past it.
A product in single precision only tells which pairs may be among the k best; these get their similarity in doubles, summed in order as
`functions.scalar.dot` sums. What comes out is for each query and cell its k best ids; the caller ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells for each task slot; similarities in single precision at a time; pairs that are summed in doubles at a time.
CELLS, PRODUCT, PAIRS = 4, 1 << 22, 1 << 18


def _length(v: pa.Array) -> np.ndarray:
    """Lengths of vectors; -1 of null ones and those with a null, which are like nothing."""
    flat, sizes = v.flatten(), np.asarray(v.value_lengths().fill_null(-1)).astype(np.int64)
    if flat.null_count:
        owner = np.repeat(np.arange(len(v)), np.maximum(sizes, 0))
        sizes[np.unique(owner[np.asarray(flat.is_null())])] = -1
    return sizes


def _matrix(v: pa.Array, size: int, lengths: np.ndarray) -> np.ndarray:
    """Vectors of that length, the others as zeros."""
    out = np.zeros((len(v), max(size, 1)))
    own = np.flatnonzero(lengths == size)
    if len(own) and size > 0:
        out[own] = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)
    return out


def _sizes(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for d in range(m.shape[1]):
            total += m[:, d] * m[:, d]
    return np.sqrt(total)


def _unit(m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and which have none that says anything: they go with all."""
    odd = ~np.isfinite(size) | (size > 1e150) | ((size > 0) & (size < 1e-150))
    with np.errstate(all="ignore"):
        return np.where((odd | (size == 0))[:, None], 0, m / np.where(size > 0, size, 1)[:, None]).astype(np.float32), odd


def _order(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


class _Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, sources: list[str | None], k: int, others: bool):
        self.ids, self.k, n = ids, k, len(ids)
        self.lengths = _length(vectors)
        self.groups = []
        for size in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == size)
            m = _matrix(vectors.take(pa.array(own)), size, self.lengths[own])
            self.groups.append((int(size), own, m, _sizes(m), *_unit(m, _sizes(m))))
        self.of: dict = {}
        for i, x in enumerate(ids.to_pylist() if others else ()):
            self.of.setdefault(x, []).append(i)
        self.codes = {s: i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
        self.code = np.array([self.codes.get(s, -1) for s in sources])
        self.least = np.full(n, -np.inf)
        self.query, self.score, self.row = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: pa.Array, vectors: pa.Array, sources: list[str | None]) -> None:
        step = max(64, PRODUCT // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            self._add(ids.slice(at, step), vectors.slice(at, step), np.array(sources[at : at + step], object))

    def _add(self, ids: pa.Array, vectors: pa.Array, sources: np.ndarray) -> None:
        lengths, values = _length(vectors), ids.to_numpy(zero_copy_only=False)
        for size, own, queries, query_size, unit, odd in self.groups:
            m = _matrix(vectors, size, lengths)
            # what has no similarity, as it is null or of another length, has 0 with every vector
            blank = (lengths != size) | (size < 0)
            kept = self._copies(m, blank, sources, _order(values))
            m, blank, there, names = m[kept], blank[kept], values[kept], sources[kept]
            row_size = _sizes(m)
            row_unit, row_odd = _unit(m, row_size)
            near = unit @ row_unit.T
            near[:, row_odd] = np.inf
            near[odd] = np.inf
            narrow = np.flatnonzero(self.code[own] >= 0)
            if len(narrow):
                theirs = np.array([self.codes.get(x, -2) for x in names.tolist()])
                near[narrow] = np.where(self.code[own[narrow]][:, None] == theirs, near[narrow], -np.inf)
            if self.of:
                place = {int(q): i for i, q in enumerate(own)} if len(self.groups) > 1 else None
                for j, x in enumerate(there.tolist()):
                    for q in self.of.get(x, ()):
                        i = q if place is None else place.get(q)
                        if i is not None:
                            near[i, j] = -np.inf
            # what single precision may be wrong by
            slack = 4 * (m.shape[1] + 8) * 2.0**-24
            bar = np.maximum(self.least[own] - slack, np.finfo(np.float32).min).astype(np.float32)
            hit = near >= bar[:, None]
            many = np.flatnonzero(hit.sum(1) > 4 * self.k)
            if len(many):
                kth = np.partition(near[many], -self.k, axis=1)[:, -self.k]
                hit[many] &= near[many] >= np.minimum(kth - np.float32(2 * slack), np.finfo(np.float32).max)[:, None]
            i, j = np.nonzero(hit)
            for a in range(0, len(i), PAIRS):
                x, y = i[a : a + PAIRS], j[a : a + PAIRS]
                total = np.zeros(len(x))
                with np.errstate(all="ignore"):
                    for d in range(m.shape[1]):
                        total += queries[x, d] * m[y, d]
                    both = query_size[x] * row_size[y]
                    total = np.where((both == 0) | blank[y], 0.0, total / np.where(both == 0, 1, both))
                self._keep(own[x], total, there[y])

    def _copies(self, m: np.ndarray, blank: np.ndarray, sources: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Rows without copies that can't be among the k best: k + 1 ids of a vector and source come before them."""
        same = np.unique(np.ascontiguousarray(m).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)[1]
        same = same * 2 + blank
        if len(np.unique(same)) == len(m):
            return np.arange(len(m))
        if self.codes:
            same = same * (len(m) + 1) + np.unique(np.array([x or "" for x in sources.tolist()]), return_inverse=True)[1]
        by = np.lexsort((order, same))
        g, o = same[by], order[by]
        new_group = np.r_[True, g[1:] != g[:-1]]
        new_id = new_group | np.r_[True, o[1:] != o[:-1]]
        start = np.maximum.accumulate(np.where(new_group, np.cumsum(new_id), 0))
        return np.sort(by[new_id & (np.cumsum(new_id) - start <= self.k)])

    def _keep(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.query, self.score = np.r_[self.query, query], np.r_[self.score, score]
        self.row = row if self.row is None else np.r_[self.row, row]
        # no number comes first, as Spark orders
        high = np.where(np.isnan(self.score), np.inf, self.score)
        by = np.lexsort((_order(self.row), -high, self.query))
        q = self.query[by]
        first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
        place = np.arange(len(q)) - first
        kth = by[place == self.k - 1]
        self.least[self.query[kth]] = high[kth]
        by = by[place < self.k]
        self.query, self.score, self.row = self.query[by], self.score[by], self.row[by]


def candidates(queries: DataFrame, rows: DataFrame, k: int, blocks: int, *, others: bool) -> DataFrame:
    """(query_id, id, s): ids that hold the k best rows (id, source, v) of each query (query_id, source, v), of each cell k, ties by id.

    A query with a source asks only rows of that source. others: without the row of the query's own id. Rows without an id are left out. blocks: of queries.
    """
    spark = rows.sparkSession
    cells = CELLS * spark.sparkContext.defaultParallelism
    vector = F.col("v").cast("array<double>").alias("v")
    id_type, query_type = rows.schema["id"].dataType, queries.schema["query_id"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", none(id_type).alias("id"), "source", vector, block.alias("b"), every(cells).alias("c"))
    held = rows.where("id IS NOT NULL").select(none(query_type).alias("query_id"), "id", "source", vector, every(blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("c"))
    both = asked.withColumn("side", F.lit(0)).unionByName(held.withColumn("side", F.lit(1))).withColumn("cell", (F.col("b") * cells + F.col("c")).cast("int")).drop("b", "c")
    dealt = both.repartition(cells * blocks, "cell").sortWithinPartitions("cell", "side")
    out = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, best, types = None, [], None, None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and best.row is not None:
                for a in range(0, len(best.query), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([best.ids.take(pa.array(best.query[part])), pa.array(best.row[part], types[1]), pa.array(best.score[part])], ["query_id", "id", "s"])

        for batch in batches:
            types = (batch.schema.field("query_id").type, batch.schema.field("id").type)
            cell, side = np.asarray(batch.column("cell")), np.asarray(batch.column("side"))
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cell[a] != at:
                    yield from result()
                    at, waiting, best = cell[a], [], None
                if side[a] == 0:
                    waiting.append(part)
                    continue
                if best is None:
                    if not waiting:
                        continue
                    own = pa.Table.from_batches(waiting).combine_chunks()
                    one = lambda c: own.column(c).chunk(0)  # noqa: B023, E731
                    best, waiting = _Best(one("query_id"), one("v"), one("source").to_pylist(), k, others), []
                best.add(part.column("id"), part.column("v"), part.column("source").to_pylist())
        yield from result()

    return dealt.mapInArrow(run, out)
