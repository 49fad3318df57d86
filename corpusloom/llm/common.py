"""Shared pieces: durable intermediate tables and vectorised word hashing inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that are hashed at a time in a task; bounds its numpy arrays to about 25 times this.
SLICE_BYTES = 1 << 19

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    `spark.checkpoint.dir` of the session; where that is unset, a temporary folder in local mode
    and the warehouse otherwise.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


#: Settings while a table is written: Spark removes the shuffle files of a query at its end, and sends few bytes to Python at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_scratch: list[list[str]] = []


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings in the block, and those from before it afterwards."""
    before = {c: spark.conf.get(c) for c in values}
    for c, v in values.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    Shuffle files of the write are removed after it, as nothing reads them again. In `scratch()` the table goes
    with the block's end, unless `keep` is set.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WRITING):
        df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised in this block are deleted at its end; what leaves it must be kept or collected."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _byte_table(word_bytes: np.ndarray, lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    table = mix(codes * _STEP + np.uint64(1))
    table[~word_bytes] = 0
    return table


#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    # those of a text longer than a slice go with it
    if n <= SLICE_BYTES + 1:
        _powers["up"], _powers["down"] = made
    return made[0], made[1]


@dataclass
class Words:
    """Words of a slice of texts: byte offsets into `data`, the text each belongs to, 64-bit hashes."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of `length` words that stay in a text, and their hashes."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(length):
            h = h * _STEP + self.hash[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[length - 1 :])
        return at, mix(h[at] + np.uint64(length))


def words_of(texts: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    """Words of every text (null: none). Equal words have equal hashes in any batch and task."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    text_at = offsets - lo
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_bytes[data]
    before = inside[:-1].copy()
    before[text_at] = False
    start = np.flatnonzero(inside[1:] & ~before)
    after = np.append(inside[1:], False)
    after[text_at] = False
    end = np.flatnonzero(inside[1:-1] & ~after[1 : len(data) + 1]) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_table(word_bytes, lower)[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, text_at)
    first[-1] = len(start)
    return Words(data, text_at, start, end, np.repeat(np.arange(n), np.diff(first)), hashes, first)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Memory that was freed goes back to the system: workers, idle ones too, share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in runs of about `size` bytes of text; a longer text is a run of its own."""
    texts = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def per_text(
    docs: DataFrame,
    text: str,
    keep: Sequence[str] | None,
    found: T.StructType,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """Columns `row` (struct of the kept columns, all by default) and `found` (what is made of the text).

    Both are structs, so no name of `docs` can clash. `make` is called once a task; its result maps
    a slice of texts to one array for each field of `found`.
    """
    names = docs.columns if keep is None else list(keep)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = found.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                made = pa.StructArray.from_arrays(work(part.column("text")), fields)
                yield pa.RecordBatch.from_arrays([part.column("row"), made], ["row", "found"])

    schema = T.StructType([given.schema["row"], T.StructField("found", found)])
    return given.mapInArrow(run, schema)


def ragged(lists_at: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list array of `values`, cut at the offsets `lists_at`."""
    return pa.ListArray.from_arrays(pa.array(lists_at.astype(np.int32)), values)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
