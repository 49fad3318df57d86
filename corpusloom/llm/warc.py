"""WARC archives of pages with a two-level capture index.

`write` puts pages in order of their reversed-host URL key, deals them by ranges of it, and each task streams its range into
archives (WARC/1.1, one gzip member a record, ARCHIVE_BYTES each) and, beside each, an index of the same name: entries sorted
by key in blocks of BLOCK_ENTRIES, each block a gzip member of its own. The sparse directory is in two levels: a row
an archive with its first key (a table of Spark's, `archives`), and at the end of each index its blocks' first keys and places.
`lookup` sorts the keys asked for, finds each one's archives by binary search in the first level, its blocks by
binary search in the second, its entries by binary search within a block, and reads the records by ranges of the
archive. A key with many captures runs on over blocks and archives, which are read one after the other.

Files are written by tasks to a name of their own and then moved to a name that the range decides, so a task that runs
again, or twice at once, leaves one whole file. Folders are addresses that pyarrow's file systems open (local, HDFS, S3, GCS).

Of pages with equal payloads of REVISIT_BYTES at least, that with the smallest page_id is a response (ties: smallest url;
of wholly equal rows one); the others are revisits, which refer to it and keep its length and digest. A null html is an empty payload, a null url has
an empty key and an empty address, a null page_id comes last and gives a record without one. Very long pages are read and
written whole, one at a time. An empty table gives archives without records and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

REVISIT_BYTES, BLOCK_ENTRIES, ARCHIVE_BYTES = 100, 512, 64 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ARCHIVES = T.StructType([T.StructField(c, k) for c, k in (("name", T.StringType()), ("first_key", T.StringType()), ("last_key", T.StringType()), ("records", T.LongType()), ("blocks", T.IntegerType()), ("bytes", T.LongType()))])
CAPTURE = T.StructType(
    [T.StructField(c, k) for c, k in (("key", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("payload", T.BinaryType()), ("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))]
)


def url_key(url: Column) -> Column:
    """Host parts in reverse, then the rest without scheme, user and fragment: `com,example,www)/path?query`."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#[\\s\\S]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^.*@|:(80|443)?$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header's value is one line; what would break it is escaped."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None, str | None] | None) -> bytes:
    """One record: a response with its payload, or a revisit of the page that is referred to, which repeats the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to[0], digest)}", f"WARC-Refers-To-Target-URI: {_clean(refers_to[1] or '')}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to[0]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of a record, the length of its full payload, and the payload that it holds itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


class _Archive:
    """An archive and its index, written side by side and moved to their names when whole."""

    def __init__(self, files, folder: str, name: str, block_entries: int):
        self.files, self.folder, self.name, self.block_entries = files, folder, name, block_entries
        self.temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.out = files.open_output_stream(f"{self.temporary}.warc.gz", compression=None)
        self.index = files.open_output_stream(f"{self.temporary}.cdx.gz", compression=None)
        self.at = self.index_at = self.records = 0
        self.first = self.last = ""
        self.entries: list[list] = []
        self.blocks: list[list] = []

    def add(self, key: str, made: bytes) -> None:
        member = gzip.compress(made, 6, mtime=0)
        self.out.write(member)
        self.first = key if not self.records else self.first
        self.last, self.records = key, self.records + 1
        self.entries.append([key, self.at, len(member)])
        self.at += len(member)
        if len(self.entries) == self.block_entries:
            self._block()

    def _block(self) -> None:
        data = gzip.compress(json.dumps(self.entries).encode(), 6, mtime=0)
        self.index.write(data)
        self.blocks.append([self.entries[0][0], self.index_at, len(data)])
        self.index_at, self.entries = self.index_at + len(data), []

    def close(self) -> tuple:
        if self.entries:
            self._block()
        # the directory of blocks, and its length in the last 8 bytes
        data = gzip.compress(json.dumps(self.blocks).encode(), 6, mtime=0)
        self.index.write(data + len(data).to_bytes(8, "little"))
        for stream, kind in ((self.out, "warc.gz"), (self.index, "cdx.gz")):
            stream.close()
            self.files.move(f"{self.temporary}.{kind}", f"{self.folder}/{self.name}.{kind}")
        return self.name, self.first, self.last, self.records, len(self.blocks), self.at


def write(pages: DataFrame, folder: str, work: Workspace, *, archive_bytes: int = ARCHIVE_BYTES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Archives and indexes of pages (page_id, url, html) under `folder`; the directory's first level, a row an archive."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    # counted before they are shuffled; only payloads that occur again are joined
    same = given.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    same = work.store(same, "copies")
    keyed = given.withColumn("key", url_key(F.col("url"))).join(same, "digest", "left")
    ranges = keyed.repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", F.asc_nulls_last("page_id"), "url", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root)
        no, count, archive, before, rows = TaskContext.get().partitionId(), 0, None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, digest, key, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "digest", "key", "first"))
                body = batch.column("payload")[i].as_py()
                own = (page_id, url or "", digest)
                # of wholly equal rows, which lie side by side, one is the response
                refers = first and ((first["page_id"], first["url"]) != own[:2] or own == before)
                before = own
                if archive is None:
                    archive, count = _Archive(files, root, f"pages-{no:06d}-{count:05d}", block_entries), count + 1
                archive.add(key, record(page_id, url, body, digest, (first["page_id"], first["url"]) if refers else None))
                if archive.at >= archive_bytes:
                    rows.append(archive.close())
                    archive = None
        if archive is not None:
            rows.append(archive.close())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ARCHIVES.fieldNames())

    return work.store(ranges.select("page_id", "url", "digest", "key", "first", "payload").mapInArrow(run, ARCHIVES), "archives")


class Index:
    """Reads captures of a folder's archives: binary searches in directories and blocks, then ranges of archives."""

    def __init__(self, folder: str, firsts: list[str], lasts: list[str], names: list[str]):
        self.files, self.folder = _filesystem(folder)
        self.firsts, self.lasts, self.names = firsts, lasts, names
        # keys are asked for in order, so few directories, blocks and files are open at a time
        self.directory, self.block, self.open = (lru_cache(n)(f) for n, f in ((64, self._directory), (16, self._block), (8, self._open)))

    def _open(self, name: str):
        return self.files.open_input_file(f"{self.folder}/{name}")

    def _directory(self, name: str) -> tuple[list[str], list[list]]:
        file = self.open(f"{name}.cdx.gz")
        size = file.size()
        length = int.from_bytes(file.read_at(8, size - 8), "little")
        blocks = json.loads(gzip.decompress(file.read_at(length, size - 8 - length)))
        return [b[0] for b in blocks], blocks

    def _block(self, name: str, offset: int, length: int) -> list[list]:
        return json.loads(gzip.decompress(self.open(f"{name}.cdx.gz").read_at(length, offset)))

    def entries(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of each capture of a key."""
        # archives whose range of keys holds it: both lists are sorted, as ranges follow each other
        for no in range(bisect.bisect_left(self.lasts, key), bisect.bisect_right(self.firsts, key)):
            firsts, blocks = self.directory(self.names[no])
            # an equal first key may have begun in the block before
            for _, offset, length in blocks[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                block = self.block(self.names[no], offset, length)
                for own, at, size in block[bisect.bisect_left(block, key, key=lambda e: e[0]) :]:
                    if own != key:
                        break
                    yield self.names[no], at, size

    def read(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.open(f"{name}.warc.gz").read_at(length, offset), wbits=31)


def lookup(keys: DataFrame, folder: str, archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every capture of each different key of `keys` (key), read from the archives; its payload, too, where `payloads` is set."""
    spark: SparkSession = keys.sparkSession
    # the first level: a row an archive of up to ARCHIVE_BYTES, so a millionth of the data at most
    level = [tuple(r) for r in archives.select("first_key", "last_key", "name").collect()]
    level.sort(key=lambda x: x[2])
    sent = spark.sparkContext.broadcast([list(c) for c in zip(*level, strict=True)] or [[], [], []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, *sent.value)
        for batch in batches:
            rows, held = [], 0
            for key in batch.column("key").to_pylist():
                for name, offset, length in index.entries(key):
                    headers, size, payload = parse(index.read(name, offset, length))
                    number = lambda h: int(headers[h]) if h in headers else None  # noqa: B023, E731
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
                    if headers["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{name}: the record at {offset} does not hold the payload of its digest")
                    rows.append((key, number("X-Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, payload if payloads and headers["WARC-Type"] == "response" else None, name, offset, length))
                    held += len(payload) if payloads else 100
                    if held > 1 << 22:
                        yield _captures(rows)
                        rows, held = [], 0
            if rows:
                yield _captures(rows)

    # keys are short next to what they stand for, so the archives say how many tasks read
    tasks = max(len(level), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), CAPTURE.fields, strict=True)], CAPTURE.fieldNames())
