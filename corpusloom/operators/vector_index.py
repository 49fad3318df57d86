"""Vector search by coarse cells: every row lies in one cell, a query reads the cells nearest to it, and what it reads is ranked exactly.

Cells are fitted by spherical k-means on a bounded sample (SAMPLE rows, those of the smallest hashes of their ids); all rows are
then dealt to the nearest centre. A cell is cut into parts of about PART_ROWS rows, so one that holds a third of all rows is many
tasks' work. How many cells a query probes is measured on the sample: as many as hold RECALL of the NEAR nearest sampled
rows of TRIED sampled queries, so well parted vectors probe few cells and noise probes many. A search reads the index once for all queries, and of it only the cells that some query probes: it does not scan
all rows for each block of queries. The probed share is the only loss; `retrieval.vector_top_k` is the exact way.
Null vectors, those with a value that is no number, and those of no length lie in cell 0 and have similarity 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that cells are fitted on, cells, rows of a part, rounds of k-means, rows and queries that are multiplied at a time.
SAMPLE, MOST_CELLS, PART_ROWS, ROUNDS, BLOCK = 50_000, 4096, 8192, 12, 1024
#: Share of the nearest that the probed cells hold, of how many nearest, by how many queries.
RECALL, NEAR, TRIED = 0.96, 10, 512


@dataclass
class VectorIndex:
    """Rows under a path by cell and part, and the cells' centres."""

    rows: DataFrame
    centres: np.ndarray
    parts: list[int]
    probes: int
    id: str
    vector: str


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of length 1, and of length 0 where there is none."""
    out = np.zeros((len(column), size), np.float64)
    good = [i for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == size and None not in v] if column.null_count else None
    if good is None:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == out.size:
            out = flat.astype(np.float64).reshape(out.shape)
        else:
            good = [i for i, n in enumerate(np.diff(column.offsets.to_numpy())) if n == size]
    if good:
        out[good] = np.array([column[i].as_py() for i in good], np.float64)
    out[~np.isfinite(out).all(1)] = 0
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def fit(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Centres of about sqrt(rows) cells, at most MOST_CELLS, and the cells to probe, from a sample of at most `sample` rows."""
    n = rows.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(np.sqrt(n)))))
    taken = rows.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(F.col(id).cast("string")).alias("h"), id).orderBy("h", id).limit(sample).select(vector).toArrow().column(0).combine_chunks()
    size = max((len(v) for v in taken.to_pylist()[:1]), default=0)
    points = _matrix(taken, size)
    points = points[(points != 0).any(1)]
    if not len(points):
        return np.zeros((1, size)), 1
    rng = np.random.default_rng(0)
    centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(points[i : i + BLOCK] @ centres.T).argmax(1) for i in range(0, len(points), BLOCK)])
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        # a centre without points stays where it is
        centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)
    own = np.concatenate([(points[i : i + BLOCK] @ centres.T).argmax(1) for i in range(0, len(points), BLOCK)])
    tried = points[:TRIED]
    # a query's own row is its nearest, so one more is looked at
    near = np.concatenate([np.argsort(-(tried[i : i + 64] @ points.T), axis=1)[:, 1 : NEAR + 1] for i in range(0, len(tried), 64)])
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)
    places = np.sort(place[np.arange(len(tried))[:, None], own[near]].ravel())
    return centres, int(places[min(len(places) - 1, int(RECALL * len(places)))]) + 1 if len(places) else 1


def build(rows: DataFrame, store, *, id: str = "vec_id", vector: str = "embedding", fitted: tuple[np.ndarray, int] | None = None) -> VectorIndex:
    """Every row with its cell and part; `store(df, name)` writes a table and reads it again."""
    centres, probes = fitted or fit(rows, id=id, vector=vector)
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cell = (_matrix(part.column("_vector"), centres.shape[1]) @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(cell, pa.int32())], ["row", "cell"])

    given = rows.select(F.struct(*rows.columns).alias("row"), F.col(vector).cast("array<double>").alias("_vector"))
    placed = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("cell", T.IntegerType())]))
    placed = store(placed, "cells")
    counts = dict(map(tuple, placed.groupBy("cell").count().collect()))  # MOST_CELLS rows
    parts = [max(1, -(-counts.get(c, 0) // PART_ROWS)) for c in range(len(centres))]
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(F.col(f"row.{id}").cast("string")), F.get(F.array(*map(F.lit, parts)), F.col("cell"))).cast("int"))
    ordered = dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part")
    return VectorIndex(store(ordered, "index"), centres, parts, probes, id, vector)


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int | None = None, others: bool = True) -> DataFrame:
    """(query_id, the rows' columns but the vector, similarity, rank): the k nearest rows among the cells that each query (query_id, query) probes.

    others: leave out the row of the query's own id. Ties go by id. probes: cells of a query, all of them for an exact search.
    """
    cells, size = index.centres.shape
    id, vector = index.id, index.vector
    probes = min(cells, probes or index.probes)
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                near = _matrix(part.column("query"), size) @ centres.T
                chosen = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                rows = [(i, c, p) for i, own in enumerate(chosen.tolist()) for c in own for p in range(parts[c])]
                i, c, p = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(i), part.column("query").take(i), c, p], ["query_id", "query", "cell", "part"])

    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    probed = asked.mapInArrow(probe, T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())]))
    row_type = index.rows.schema["row"].dataType
    kept = [f for f in row_type.fields if f.name != vector]
    out = T.StructType([asked.schema["query_id"], *kept, T.StructField("similarity", T.DoubleType())])

    def rank(rows: pa.Table, own: pa.Table) -> pa.Table:
        fields = [pa.field(f.name, t) for f, t in zip(kept, (rows.column("row").type.field(f.name).type for f in kept), strict=True)]
        schema = pa.schema([pa.field("query_id", own.column("query_id").type), *fields, pa.field("similarity", pa.float64())])
        if not rows.num_rows or not own.num_rows:
            return schema.empty_table()
        held = rows.column("row").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        vectors = _matrix(held.field(vector).cast(pa.list_(pa.float64())), size)
        ids, asked_ids = np.array(held.field(id).to_pylist()), own.column("query_id").to_pylist()
        queries_in = own.column("query").combine_chunks()
        queries_in = queries_in.chunk(0) if isinstance(queries_in, pa.ChunkedArray) else queries_in
        takes, places, scores = [], [], []
        for at in range(0, own.num_rows, BLOCK):
            near = _matrix(queries_in.slice(at, BLOCK), size) @ vectors.T
            for j, line in enumerate(near):
                allowed = np.flatnonzero(ids != asked_ids[at + j]) if others else np.arange(len(ids))
                if len(allowed) > k:
                    # all that tie with the last of the k best stay until ids decide
                    least = np.partition(line[allowed], -k)[-k]
                    allowed = allowed[line[allowed] >= least]
                    allowed = allowed[np.lexsort((ids[allowed], -line[allowed]))[:k]]
                takes.append(allowed)
                places.append(np.full(len(allowed), at + j))
                scores.append(line[allowed])
        take, place = pa.array(np.concatenate(takes)), pa.array(np.concatenate(places))
        return pa.Table.from_arrays([own.column("query_id").take(place), *(held.field(f.name).take(take) for f in kept), pa.array(np.concatenate(scores))], schema=schema)

    best = index.rows.groupBy("cell", "part").cogroup(probed.groupBy("cell", "part")).applyInArrow(rank, out)
    # sums in another order may differ in the last bits, so equal ones are told by a rounded value
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), id)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
