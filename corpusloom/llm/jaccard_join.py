"""Exact Jaccard join of documents' word shingles in a metric space.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a document's set holds its different `shingle`-word
windows (64-bit hashes), or all its words as one if there are fewer; none without words. Documents with
equal sets are one class. Classes link when intersection / union >= `similarity`.

1 - Jaccard is a metric, but in it unrelated documents are all at distance 1 from any document, where
triangle inequalities exclude nothing. So the outer pivots are single shingles: a class is at distance
1 - 1/n from a pivot it holds and 1 from others, and a linked pair must share one of the first
n - ceil(similarity * n) + 1 pivots of either in any fixed order. That order is rarest first, so a
class whose own shingles fill this boundary belongs to no region and is done. The regions of shared
pivots then join recursively and exactly: a member is taken as inner pivot, its distance to the others
is computed, near ones are linked, and a region whose members are all in one component is done. After
`LEVELS` inner pivots only members of different components whose distances to every one of them differ
by no more than 1 - similarity can still link; such pairs are compared, block by block, if they share
enough outer pivots, and a block gives only links enough to connect what it links.

Shingles are counted by hash bucket over packed arrays. A shingle that a task sees in very many documents is
broadcast as frequent (a bounded list), is ordered last, and never gathers in a bucket.
A null or empty text has no set, no links and its own doc_id as component; a null doc_id takes part
and orders last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, Words, give_back, materialise, mix, scratch, slices, words_of
from .components import components

SHINGLE, PERCENT = 5, 75
#: Share of a task's documents from which a shingle is frequent, and the most that are broadcast (8 bytes each).
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.004, 40, 1_000_000
#: Text bytes in which a task looks for frequent shingles at a time.
SLICE = 2 << 20
#: Shingles a bucket should hold, shingles packed at a time, classes whose hashes are broadcast to fetch their texts.
BUCKET_SHINGLES, PACKED, BROADCAST_CLASSES = 200_000, 1_000_000, 1_000_000
#: Pairs (32 bytes each) that are broadcast to choose the sets they need.
BROADCAST_PAIRS = 250_000
#: Inner pivots that each region tries in turn before its blocks, of so many members and shingles, are compared.
LEVELS, BLOCK, BLOCK_SHINGLES = 3, 512, 1_000_000
#: Shingles of a block that are multiplied at a time.
COLUMNS = 4096


def shingle_sets(w: Words, length: int) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    at, h = w.windows(length)
    cuts = np.searchsorted(at, w.first)
    out = []
    for k, n in enumerate(w.count().tolist()):
        if n >= length:
            out.append(np.unique(h[cuts[k] : cuts[k + 1]]))
        elif n:
            own = w.hash[w.first[k] : w.first[k + 1]]
            whole = np.array([n], np.uint64)
            for x in own:
                whole = mix(whole * np.uint64(31) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> bytes | None:
    """128 bits that equal sets share."""
    if not len(own):
        return None
    return np.array([own.sum() + np.uint64(len(own)), mix(own).sum()], ">u8").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray], list[bytes | None]]]:
    """Parts of the batches with the ref of their first row, their sets and set ids."""
    ref = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch, size=SLICE):
            sets = shingle_sets(words_of(part.column("text"), NONSPACE, True), length)
            yield part, ref, sets, [set_id(x) for x in sets]
            ref += part.num_rows


def _check(ids: list[bytes | None]) -> int:
    return sum(int.from_bytes(i[:6], "big") for i in ids if i is not None)


_SCAN = "kind int, doc_id bigint, text_hash bigint, n bigint, id binary, ref bigint, shingle bigint"
_KINDS = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "id": pa.binary(), "ref": pa.int64(), "shingle": pa.int64()}


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    own = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * size), t) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), *own], ["kind", *_KINDS])


def _scan(given: DataFrame, length: int) -> DataFrame:
    """kind 0: a row for each document; 1: shingles that are frequent in a task's documents; 2: checksum of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[int, int] = {}
        total = check = 0
        for part, ref, sets, ids in _sets(batches, length):
            # copies count once
            new = {i: x for i, x in zip(ids, sets, strict=True) if i is not None}
            total += len(new)
            check += _check(ids)
            if new:
                u, n = np.unique(np.concatenate(list(new.values())), return_counts=True)
                some = n >= max(3, HOT_SHARE * len(new))
                for x, c in zip(u[some].tolist(), n[some].tolist(), strict=True):
                    many[x] = many.get(x, 0) + c
            size = len(ids)
            yield _rows(0, size, doc_id=part.column("doc_id"), text_hash=part.column("text_hash"), n=[len(x) for x in sets], id=ids, ref=np.arange(ref, ref + size))
        hot = [(x, c) for x, c in many.items() if c >= max(HOT_LEAST, HOT_SHARE * total)]
        if hot:
            yield _rows(1, len(hot), shingle=np.array([x for x, _ in hot], np.uint64).view(np.int64), n=[c for _, c in hot])
        yield _rows(2, 1, ref=[TaskContext.get().partitionId()], n=[check % (1 << 62)])

    return materialise(given.mapInArrow(run, _SCAN), "sets")


class _Hot:
    """Frequent shingles with their place in the common order (least frequent first)."""

    def __init__(self, order: np.ndarray):
        rank = np.argsort(order)
        self.known, self.rank = order[rank], rank

    def places(self, own: np.ndarray) -> np.ndarray:
        """Place of each shingle, -1 of those that are not frequent."""
        if not len(self.known) or not len(own):
            return np.full(len(own), -1)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        return np.where(self.known[at] == own, self.rank[at], -1)


def _boundary(n: int, percent: int) -> int:
    """How many first pivots of a set of n any linked set must share one of; one more, for equal short hashes."""
    return n - (n * percent + 99) // 100 + 2


def _narrow(values: np.ndarray) -> str:
    most = int(values.max())
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def _members(given: DataFrame, scanned: DataFrame, length: int, percent: int) -> DataFrame:
    """(region, id, n): the boundary pivots of each class that other classes hold too."""
    spark = given.sparkSession
    found = scanned.where("kind = 1").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(HOT_MOST).collect()
    hot = spark.sparkContext.broadcast(_Hot(np.array([r["shingle"] for r in reversed(found)], np.int64).view(np.uint64)))
    # one number for each task
    checks = spark.sparkContext.broadcast({r["ref"]: r["n"] for r in scanned.where("kind = 2").select("ref", "n").collect()})
    total = scanned.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    bits = min(22, max(6, math.ceil(math.log2(max(1, total / BUCKET_SHINGLES)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = check = 0

        def packed() -> pa.RecordBatch:
            own = np.concatenate([x for _, x in held])
            which = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
            bucket = (own & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, which, bucket = own[order] >> np.uint64(bits), which[order], bucket[order]
            # 32 bits beside the bucket's are enough: equal ones of different shingles only add candidates
            short = own.astype("<u4")
            used, cuts = np.unique(bucket, return_index=True)
            cuts = np.append(cuts, len(bucket))
            refs = np.array([r for r, _ in held], np.int64)
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                docs, counts = np.unique(which[lo:hi], return_counts=True)
                # steps between documents and their counts are small numbers
                steps = np.diff(refs[docs], prepend=refs[0])
                for into, values in zip(out, (steps, counts), strict=False):
                    into.append(values.astype(_narrow(values)).tobytes())
                out[2].append(len(docs))
                out[3].append(short[lo:hi].tobytes())
            columns = [pa.array(x, pa.int32() if k == 2 else pa.binary()) for k, x in enumerate(out)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([int(refs[0])] * len(used), pa.int64()), *columns], ["bucket", "ref", "docs", "counts", "n_docs", "shingles"])

        for _, ref, sets, ids in _sets(batches, length):
            check += _check(ids)
            for k, (own, key) in enumerate(zip(sets, ids, strict=True)):
                if key is None or key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                rare = own[hot.value.places(own) < 0]
                if len(rare):
                    held.append((ref + k, rare))
                    size += len(rare)
            if size > PACKED:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()
        if checks.value.get(TaskContext.get().partitionId(), 0) != check % (1 << 62):
            raise RuntimeError("the input gave other rows when it was read again; pass stable=False")

    def shared(given: pa.Table) -> pa.Table:
        refs, keys = [], []
        for row in given.to_pylist():
            steps, counts = (np.frombuffer(row[c], f"<u{len(row[c]) // row['n_docs']}").astype(np.int64) for c in ("docs", "counts"))
            refs.append(np.repeat(row["ref"] + np.cumsum(steps), counts))
            keys.append(np.frombuffer(row["shingles"], "<u4"))
        ref, key = np.concatenate(refs), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        ref, key = ref[order], key[order]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        df = np.repeat(counts, counts)
        some = df > 1
        key = ((key[some].astype(np.int64) << bits) | given["bucket"][0].as_py()) & ((1 << 62) - 1)
        ref, df = ref[some], df[some]
        give_back()
        return pa.table({"ref": ref, "shingle": key, "df": pa.array(df, pa.int32())})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent shingles of each document that has some: how many, and those within its boundary."""
        for _, ref, sets, ids in _sets(batches, length):
            rows = []
            for k, (own, key) in enumerate(zip(sets, ids, strict=True)):
                places = hot.value.places(own) if key is not None else np.zeros(0, int)
                some = int((places >= 0).sum())
                if some:
                    need = _boundary(len(own), percent) - (len(own) - some)
                    rows.append((ref + k, some, np.sort(places[places >= 0])[: max(0, need)].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["ref", "n_hot", "hot"])

    dealt = given.mapInArrow(deal, "bucket int, ref bigint, docs binary, counts binary, n_docs int, shingles binary")
    # dealt by document before they are gathered, as lists of one shingle each would be larger
    held = dealt.groupBy("bucket").applyInArrow(shared, "ref bigint, shingle bigint, df int").repartition("ref").groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    dims = scanned.where("kind = 0 AND id IS NOT NULL").select("ref", "id", "n")
    own = dims.join(held, "ref", "left")
    if found:
        own = own.join(materialise(given.mapInArrow(last, "ref bigint, n_hot bigint, hot array<bigint>"), "frequent"), "ref", "left")
    else:
        own = own.withColumn("n_hot", F.lit(0).cast("bigint")).withColumn("hot", F.array().cast("array<bigint>"))
    m = F.greatest(F.coalesce(F.size("held"), F.lit(0)), F.lit(0))
    alone = F.col("n") - F.coalesce("n_hot", F.lit(0)) - m
    # _boundary
    width = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 2
    place = "array<struct<hot:int,df:int,region:bigint>>"
    rare = F.transform(F.slice("held", F.lit(1), F.greatest(F.lit(0), F.least(width - alone, m)).cast("int")), lambda x: F.struct(F.lit(0).alias("hot"), x["df"].alias("df"), x["shingle"].alias("region")))
    late = F.transform("hot", lambda x: F.struct(F.lit(1).alias("hot"), x.cast("int").alias("df"), (-1 - x).alias("region")))
    pivots = F.concat(F.coalesce(rare.cast(place), F.array().cast(place)), F.coalesce(late.cast(place), F.array().cast(place)))
    own = own.where(width > alone).select("id", "n", width.alias("width"), (alone / F.col("n")).alias("alone"), pivots.alias("pivots")).where(F.size("pivots") > 0)
    # rows of copies are equal
    return materialise(own.withColumn("last", F.element_at("pivots", -1)).distinct().select("id", "n", "width", "alone", "last", F.explode("pivots.region").alias("region")), "members")


def _fetch(given: DataFrame, scanned: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """(id, shingles) of every class that is in some region."""
    ids = materialise(members.select("id").distinct(), "ids")
    wanted = scanned.where("kind = 0").join(ids, "id", "left_semi").groupBy("id").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
    if ids.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets, ids in _sets(batches, length):
            rows = list({i: x for i, x in zip(ids, sets, strict=True) if i is not None}.items())
            values = np.concatenate([x for _, x in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["id", "shingles"])

    sets = given.join(wanted, "text_hash", "left_semi").select("text").mapInArrow(run, "id binary, shingles array<bigint>")
    return materialise(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")


def _measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of each pair."""
    pairs = materialise(pairs, "pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        # sets that meet no other stay where they are
        met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = sets.join(F.broadcast(met), "id", "left_semi")
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    whole = F.col("sizes") - F.col("common")
    return materialise(common.select("a", "b", (1 - F.col("common") / whole).alias("distance"), (100 * F.col("common") >= percent * whole).alias("linked")), "distances")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after further links."""
    edges = links.select("a", "b")
    return components(edges if parts is None else edges.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of all linked classes, by recursion over the regions; None if there are no links."""
    near = 1 - percent / 100 + 1e-9
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    known = parts = None
    own = members.select("region", "id", "n", "alone", F.lit(None).cast("array<double>").alias("far"), F.lit(None).cast("binary").alias("before"))
    for level in range(LEVELS):
        part = F.col("id") if parts is None else F.coalesce("component", "id")
        own = (own if parts is None else own.join(parts.withColumnRenamed("node", "id"), "id", "left")).withColumn("part", part)
        # a member whose shingles are shared most is near most others; later ones come from another component
        new = F.struct((F.col("part") == F.col("before")).alias("same"), "alone", "n", "id", "part")
        regions = own.groupBy("region").agg(F.min(new).alias("pivot"), F.min("part").alias("one"), F.max("part").alias("other")).where("one <> other")
        pivot = regions.select("region", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("m"), F.col("pivot.part").alias("pivot_part"))
        own = materialise(own.select("region", "id", "n", "alone", "far", "part").join(pivot, "region"), "regions")
        if own.isEmpty():
            return parts
        apart = F.lit(True) if level == 0 else (F.col("part") != F.col("pivot_part")) & fits
        pairs = own.where((F.col("id") != F.col("pivot")) & apart).select(*_pair("id", "pivot")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        new = _measure(pairs, sets, percent)
        known = new if known is None else known.unionByName(new)
        linked = new.where("linked")
        if not linked.isEmpty():
            parts = _merged(parts, linked)
        # the pivot has met all members; the others keep their distance to it
        rest = own.where("id <> pivot").withColumns(dict(zip("ab", _pair("id", "pivot"), strict=True))).join(known, ["a", "b"], "left")
        far = F.concat(F.coalesce("far", F.array().cast("array<double>")), F.array(F.col("distance")))
        own = rest.select("region", "id", "n", "alone", far.alias("far"), F.col("pivot_part").alias("before"))
    # what is left is compared by the pivots it shares, block by block
    part = F.col("id") if parts is None else F.coalesce("component", "id")
    own = (own if parts is None else own.join(parts.withColumnRenamed("node", "id"), "id", "left")).withColumn("part", part)
    mixed = own.groupBy("region").agg(F.min("part").alias("one"), F.max("part").alias("other"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("one <> other").select("region", "size", "weight")
    own = materialise(own.select("region", "id", "n", "far", "part").join(mixed, "region"), "rest")
    # at most a set's boundary
    dims = members.select("id", "width", "last.hot", "last.df", "region").join(mixed.select("region"), "region", "left_semi").groupBy("id")
    dims = dims.agg(F.first("width").alias("width"), F.first("hot").alias("hot"), F.first("df").alias("df"), F.collect_list("region").alias("shared"))
    last = members.select("id", F.col("last.region").alias("last")).distinct()
    tasks = max(64, own.count() // 20_000)
    count = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.hash("id"), count)
    # a member's block meets itself and every other block of its region once
    meets = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (block <= j).alias("left"), (block >= j).alias("right")))
    dealt = own.join(dims, "id").join(last, "id").select("*", F.inline(meets))
    dealt = dealt.withColumn("task", F.when(count == 1, F.pmod(F.xxhash64("region"), F.lit(tasks))).otherwise(F.xxhash64("region", "i", "j")))
    dealt = dealt.drop("size", "weight")
    # blocks lose the members that have no candidate in them before the others' sets join
    alive = materialise(dealt.groupBy("task").applyInArrow(lambda t: _with_candidates(t, percent, near), dealt.schema), "blocks")
    size = alive.agg(F.sum("n")).first()[0]
    if not size:
        return parts
    groups = max(64, size // BLOCK_SHINGLES)
    full = alive.join(sets, "id").withColumn("task", F.pmod(F.xxhash64("region", "i", "j"), F.lit(groups)))
    return _merged(parts, full.groupBy("task").applyInArrow(lambda t: _forests(t, percent, near), "a binary, b binary").distinct())


def _blocks(given: pa.Table, percent: int, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, other rows, and which of them can link: other components, sizes that fit, near distances to every pivot, enough shared pivots.

    `given` is sorted by region, i and j.
    """
    keys = np.stack([given[c].to_numpy().astype(np.int64) for c in ("region", "i", "j")])
    _, part = np.unique(np.array(given["part"].to_pylist(), object), return_inverse=True)
    n, width, left, right = (given[c].to_numpy() for c in ("n", "width", "left", "right"))
    far = np.array([[np.nan if x is None else x for x in row] for row in given["far"].to_pylist()], np.float64)
    order = np.lexsort((given["last"].to_numpy(), given["df"].to_numpy(), given["hot"].to_numpy()))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared = given["shared"].combine_chunks()
    at, values = shared.offsets.to_numpy(), shared.values.to_numpy()
    cuts = np.flatnonzero(np.r_[True, (np.diff(keys) != 0).any(0), True]) if given.num_rows else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = values[at[lo] : at[hi]]
        seen, column = np.unique(own, return_inverse=True)
        has = np.zeros((hi - lo, len(seen)), np.float32)
        has[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), column] = 1
        x, y = np.flatnonzero(left[lo:hi]), np.flatnonzero(right[lo:hi])
        common = has[x] @ has[y].T
        x, y = x + lo, y + lo
        nx, ny = n[x][:, None], n[y][None, :]
        # all common pivots are counted, so the rest of the set whose boundary ends first bounds what else is common
        rest = np.where(rank[x][:, None] <= rank[y][None, :], (n - width)[x][:, None], (n - width)[y][None, :])
        ok = ((100 + percent) * (common + 2 + rest) >= percent * (nx + ny)) & (part[x][:, None] != part[y][None, :])
        ok &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        for k in range(far.shape[1]):
            ok &= ~(np.abs(far[x, k][:, None] - far[y, k][None, :]) > near)
        # a pair belongs to the first region of both; if one was a pivot there, it has met the other
        i, j = np.nonzero(ok)
        step = max(1, (1 << 22) // max(1, len(seen)))
        for k in range(0, len(i), step):
            first = (has[x[i[k : k + step]] - lo] * has[y[j[k : k + step]] - lo]).argmax(1)
            ok[i[k : k + step], j[k : k + step]] = seen[first] == keys[0, lo]
        yield x, y, ok


def _in_order(given: pa.Table) -> pa.Table:
    return given.sort_by([(c, "ascending") for c in ("region", "i", "j")])


def _with_candidates(given: pa.Table, percent: int, near: float) -> pa.Table:
    """The rows that can link with some other row of their block."""
    given = _in_order(given)
    stays = np.zeros(given.num_rows, bool)
    for x, y, ok in _blocks(given, percent, near):
        stays[x[ok.any(1)]] = True
        stays[y[ok.any(0)]] = True
    return given.filter(pa.array(stays))


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set shares with each of the others."""
    shared = np.intersect1d(np.concatenate(sets), np.concatenate(others))
    total = np.zeros((len(sets), len(others)), np.float32)
    left, right = _places(sets, shared), _places(others, shared)
    for at in range(0, len(shared), COLUMNS):
        total += _holds(*left, at, len(sets)) @ _holds(*right, at, len(others)).T
    return total


def _places(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and place in `shared` (sorted) of each shingle that is there, by place."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if not len(shared):
        return owner[:0], owner[:0]
    at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    there = np.flatnonzero(shared[at] == values)
    there = there[np.argsort(at[there], kind="stable")]
    return owner[there], at[there]


def _holds(owner: np.ndarray, place: np.ndarray, at: int, count: int) -> np.ndarray:
    lo, hi = np.searchsorted(place, [at, at + COLUMNS])
    out = np.zeros((count, COLUMNS), np.float32)
    out[owner[lo:hi], place[lo:hi] - at] = 1
    return out


def _forests(given: pa.Table, percent: int, near: float) -> pa.Table:
    """Links between rows of a block, whose sets are compared whole; of those in a block only a spanning forest, which connects the same rows."""
    given = _in_order(given)
    ids, lists = given["id"].to_pylist(), given["shingles"].combine_chunks()
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = lambda rows: [values[at[k] : at[k + 1]] for k in rows.tolist()]
    out_a, out_b = [], []
    for x, y, ok in _blocks(given, percent, near):
        if not ok.any():
            continue
        some_x, some_y = ok.any(1), ok.any(0)
        x, y, ok = x[some_x], y[some_y], ok[some_x][:, some_y]
        common = _common(sets(x), sets(y))
        sizes = (at[x + 1] - at[x])[:, None] + (at[y + 1] - at[y])[None, :]
        linked = ok & (100 * common.astype(np.int64) >= percent * (sizes - common.astype(np.int64)))
        rows = np.union1d(x, y)
        near_by = np.zeros((len(rows), len(rows)), bool)
        i, j = np.nonzero(linked)
        i, j = np.searchsorted(rows, x[i]), np.searchsorted(rows, y[j])
        near_by[i, j] = near_by[j, i] = True
        free = near_by.any(1)
        while free.any():
            reached = [int(np.argmax(free))]
            free[reached[0]] = False
            for k in reached:
                new = np.flatnonzero(near_by[k] & free).tolist()
                free[new] = False
                reached += new
                for m in new:
                    a, b = ids[rows[k]], ids[rows[m]]
                    out_a.append(min(a, b))
                    out_b.append(max(a, b))
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def join(docs: DataFrame, *, similarity_percent: int = PERCENT, shingle: int = SHINGLE, stable: bool = False) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles and component_id of every row of `docs`.

    stable: reading `docs` again gives the same rows in the same partitions, as files do; otherwise they
    are written to the shared folder first.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    # the tables that the join works with go as soon as its result is written
    with scratch(docs.sparkSession):
        return materialise(_joined(given if stable else materialise(given, "texts"), shingle, similarity_percent), "joined", keep=True)


def _joined(given: DataFrame, shingle: int, similarity_percent: int) -> DataFrame:
    scanned = _scan(given, shingle)
    members = _members(given, scanned, shingle, similarity_percent)
    parts = None if members.isEmpty() else _links(members, _fetch(given, scanned, members, shingle), similarity_percent)
    rows = scanned.where("kind = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "id")
    classes = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("least"))
    if parts is not None:
        classes = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = classes.join(least, "component").select("id", "component_id")
    else:
        classes = classes.withColumnRenamed("least", "component_id")
    return rows.join(classes, "id", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """One row of each component: its least doc_id, of rows with that one the least text hash.

    Documents without words all stay, as they are linked with nothing.
    """
    found = join(docs, **params)
    some = found.where("n_shingles > 0")
    first = some.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    stays = first.select(F.col("first.doc_id").alias("_doc_id"), F.col("first.text_hash").alias("_text_hash"))
    # rows are structs, so no column of theirs can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash")).alias("_key"))
    empty = found.where("n_shingles = 0").select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    same = lambda o: F.col("_key.id").eqNullSafe(o["_doc_id"]) & (F.col("_key.hash") == o["_text_hash"])
    one = keyed.join(stays, same(stays), "left_semi").dropDuplicates(["_key"])
    return one.unionByName(keyed.join(empty, same(empty), "left_semi")).select("row.*")
