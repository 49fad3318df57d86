"""Token-ID files: patched frame-of-reference blocks with an index of block starts.

A segment is a self-describing byte string of many whole documents' ids:

    header    "PFOR", version, numbers of ids, blocks and exceptions (little-endian, 32 bits)
    minima    32 bits a block
    widths    8 bits a block
    starts    index: 32 bits a block, 64-bit words of packed data before it
    patches   index: 32 bits a block, exceptions before it
    packed    BLOCK ids less the minimum, `width` bits each, from the lowest bit up
    exceptions 8 bits place in the block, then 32 bits less the minimum, for each

A block's width holds PERCENTILE of its ids; what is wider goes to the exceptions. Documents are dealt
by ranges of doc_id, sorted, and cut into segments at document ends. Segments are rows of a Parquet
table, as only Spark's writers commit whole files to any store; each has the documents' ids and lengths.

Null and empty texts have only the end id. Repeated doc_ids follow each other, ordered by their text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder_for
from .common import slices

BLOCK, PERCENTILE, SEGMENT_IDS = 128, 0.9, 1 << 20
_HEAD = struct.Struct("<4sIIII")


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that hold each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The segment of these ids (below 2 ** 32)."""
    n = len(ids)
    count = -(-n // BLOCK)
    values = np.zeros(count * BLOCK, np.uint64)
    values[:n] = ids
    values[n:] = values[n - 1] if n else 0
    values = values.reshape(count, BLOCK)
    low = values.min(1) if count else np.zeros(0, np.uint64)
    rest = values - low[:, None]
    widths = _width(np.partition(rest, int(PERCENTILE * (BLOCK - 1)), 1)[:, int(PERCENTILE * (BLOCK - 1))]) if count else np.zeros(0, np.uint8)
    limit = (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)
    wide = rest > limit[:, None]
    row, col = np.nonzero(wide)
    patched = rest[row, col].astype("<u4")
    rest = np.where(wide, 0, rest)
    words = widths.astype(np.int64) * BLOCK // 64
    starts = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(int(starts[-1]), np.uint64)
    for width in np.unique(widths):
        width = int(width)
        if not width:
            continue
        own = np.flatnonzero(widths == width)
        columns = np.ascontiguousarray(rest[own].T)
        made = np.zeros((width * BLOCK // 64, len(own)), np.uint64)
        for j in range(BLOCK):
            at, shift = divmod(j * width, 64)
            made[at] |= columns[j] << np.uint64(shift)
            if shift + width > 64:
                made[at + 1] |= columns[j] >> np.uint64(64 - shift)
        out[(starts[own][:, None] + np.arange(made.shape[0])).ravel()] = made.T.ravel()
    patches = np.concatenate([[0], np.cumsum(wide.sum(1))])[:-1] if count else np.zeros(0, np.int64)
    return b"".join(
        (
            _HEAD.pack(b"PFOR", 1, n, count, len(patched)),
            low.astype("<u4").tobytes(),
            widths.tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            patches.astype("<u4").tobytes(),
            out.astype("<u8").tobytes(),
            col.astype(np.uint8).tobytes(),
            patched.tobytes(),
        )
    )


class Segment:
    """Reads a segment, whole or some blocks of it by the index."""

    def __init__(self, data: bytes):
        magic, version, self.n, self.count, self.exceptions = _HEAD.unpack_from(data)
        if magic != b"PFOR" or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.low, self.widths = take("<u4", self.count), take("u1", self.count)
        self.starts, self.patches = take("<u4", self.count), take("<u4", self.count)
        self.packed = take("<u8", int((self.widths.astype(np.int64) * BLOCK // 64).sum()))
        self.places, self.values = take("u1", self.exceptions), take("<u4", self.exceptions)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from `first` to before `last`."""
        last = self.count if last is None else last
        out = np.zeros((max(0, last - first), BLOCK), np.uint64)
        widths = self.widths[first:last]
        for width in np.unique(widths):
            width = int(width)
            if not width:
                continue
            own = np.flatnonzero(widths == width)
            n = width * BLOCK // 64
            words = np.ascontiguousarray(self.packed[self.starts[first:last][own].astype(np.int64)[:, None] + np.arange(n)].T)
            mask = np.uint64((1 << width) - 1)
            made = np.zeros((BLOCK, len(own)), np.uint64)
            for j in range(BLOCK):
                at, shift = divmod(j * width, 64)
                made[j] = words[at] >> np.uint64(shift)
                if shift + width > 64:
                    made[j] |= words[at + 1] << np.uint64(64 - shift)
                made[j] &= mask
            out[own] = made.T
        ends = np.append(self.patches, self.exceptions)
        lo, hi = int(ends[first]), int(ends[last])
        block = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1].astype(np.int64)))
        out[block, self.places[lo:hi]] = self.values[lo:hi]
        out += self.low[first:last].astype(np.uint64)[:, None]
        return out.ravel()[: self.n - first * BLOCK].astype("<u4")


SEGMENTS = T.StructType(
    [
        T.StructField("range_no", T.IntegerType()),
        T.StructField("segment_no", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("data", T.BinaryType()),
    ]
)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, partitions: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the segments under `path`, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        no, first, segment = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal first, segment, held, doc_ids, lengths
            ids = np.concatenate(held)
            columns = [[no], [segment], [first], [doc_ids], [lengths], [pack(ids)]]
            first, segment, held, doc_ids, lengths = first + len(ids), segment + 1, [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SEGMENTS.fieldNames())

        filled = 0
        for batch in batches:
            for part in slices(batch):
                at, ids = encoder.encode(part.column("text"))
                own = np.insert(ids, at[1:], end_id)
                n = np.diff(at) + 1
                ends = np.cumsum(n)
                numbers, begin = part.column("doc_id").to_pylist(), 0
                while begin < len(n):
                    base = int(ends[begin - 1]) if begin else 0
                    # whole documents, up to the one that fills the segment
                    to = min(len(n), begin + 1 + int(np.searchsorted(ends[begin:], base + segment_ids - filled)))
                    held.append(own[base : int(ends[to - 1])])
                    doc_ids += numbers[begin:to]
                    lengths += n[begin:to].tolist()
                    filled += int(ends[to - 1]) - base
                    begin = to
                    if filled >= segment_ids:
                        yield flush()
                        filled = 0
        if held:
            yield flush()

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = given.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, 32 bits each)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # one row for each range of doc_ids
    totals = segments.select("range_no", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("range_no").agg(F.sum("n").alias("n")).collect()
    before, starts = 0, {}
    for range_no, n in sorted(map(tuple, totals)):
        starts[range_no] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Segment(row["data"]).ids()
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                begins = ends - row["lengths"]
                whole = ids.tobytes()
                for at in range(0, len(ends), 2000):
                    a, b = begins[at : at + 2000], ends[at : at + 2000]
                    columns = [
                        pa.array(row["doc_ids"][at : at + 2000], pa.int64()),
                        pa.array(a + starts[row["range_no"]] + row["first"], pa.int64()),
                        pa.array(b - a, pa.int64()),
                        pa.array([whole[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return segments.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
