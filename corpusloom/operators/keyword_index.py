"""Search for parts of texts by postings of trigrams: many keywords at once, each candidate held against its text.

A text's trigrams are all runs of three characters of its lower-case form. Postings are rows (gram, block, ids) of ids in
order. A block is some texts that a task reads one after the other, BLOCK_IDS texts or about BLOCK_CHARS characters at most (a longer text
is one of its own), so its postings are made where its texts lie, and a very frequent trigram is many rows. A keyword is looked up by its
RAREST trigrams; ids in all of their postings of a block are candidates, and a candidate counts if its text holds the keyword. Keywords
of fewer than three characters have no trigram and scan the texts, in blocks of SHORT.
A null text or keyword finds nothing; an empty keyword finds every text that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_IDS, BLOCK_CHARS, RAREST, SHORT = 1 << 16, 1 << 21, 4, 1000
#: Keywords whose trigrams are broadcast to the postings.
SENT = 20_000


def trigrams(text: Column) -> Column:
    """Different runs of three characters of the lower-case text; none of a shorter or null one."""
    runs = F.transform(F.sequence(F.lit(1), F.length(F.lower(text)) - 2), lambda i: F.substr(F.lower(text), i, F.lit(3)))
    return F.when(F.length(F.lower(text)) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _codes(text: str) -> np.ndarray:
    """The different trigrams of a text as numbers of three times 21 bits, in order."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _postings(held: list[tuple[int, np.ndarray]], block: int) -> pa.RecordBatch:
    held = sorted(held, key=lambda x: x[0])
    codes = np.concatenate([c for _, c in held])
    ids = np.repeat(np.array([i for i, _ in held], np.int64), [len(c) for _, c in held])
    by = np.argsort(codes, kind="stable")
    codes, ids = codes[by], ids[by]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    three = codes[starts, None] >> np.array([42, 21, 0]) & 0x1FFFFF
    text = three.astype("<u4").tobytes().decode("utf-32-le")
    grams = [text[i : i + 3] for i in range(0, len(text), 3)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)].astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.full(len(grams), block)), lists], ["gram", "block", "ids"])


@dataclass
class KeywordIndex:
    postings: DataFrame
    counts: DataFrame


def build(rows: DataFrame, store, *, id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """Postings of all whole texts, and how many ids each trigram has; `store(df, name)` writes a table and reads it again. Ids are whole numbers."""
    most, chars = BLOCK_IDS, BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((i, _codes(x)))
                size += len(x)
                if len(held) >= most or size >= chars:
                    yield _postings(held, block)
                    held, size, block = [], 0, block + 1
        if held:
            yield _postings(held, block)

    lower = rows.select(F.col(id).cast("bigint").alias("id"), F.lower(text).alias("text")).where("id IS NOT NULL AND length(text) >= 3")
    postings = store(lower.mapInArrow(run, "gram string, block bigint, ids array<bigint>"), "postings")
    return KeywordIndex(postings, store(postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")), "gram-counts"))


def _held(keywords: str, text: str) -> Column:
    """Those of `keywords` (array) that the text holds, which is put in lower case once."""
    return F.transform(F.array(F.lower(text)), lambda t: F.filter(keywords, lambda k: F.contains(t, F.lower(k))))[0]


def search(index: KeywordIndex, rows: DataFrame, keywords: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(keyword, id): rows whose text holds the keyword (keyword), in any case, for each different keyword."""
    asked = keywords.where("keyword IS NOT NULL").select("keyword").distinct()
    long = asked.where(F.length(F.lower("keyword")) >= 3)
    grams = long.select("keyword", F.explode(trigrams(F.col("keyword"))).alias("gram"))
    # a trigram that no text holds comes first, and finds nothing
    known = grams.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.withColumn("k", F.row_number().over(Window.partitionBy("keyword").orderBy("n", "gram"))).where(F.col("k") <= RAREST)
    rarest = rarest.select("keyword", "gram", F.count(F.lit(1)).over(Window.partitionBy("keyword")).alias("need"))
    rarest = F.broadcast(rarest) if asked.limit(SENT + 1).count() <= SENT else rarest
    # a block in which not all trigrams have postings holds no candidate
    met = index.postings.join(rarest, "gram").groupBy("keyword", "block").agg(F.collect_list("ids").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need"))
    common = F.aggregate(F.slice("lists", 2, RAREST), F.col("lists")[0], F.array_intersect)
    candidates = met.select("keyword", F.explode(common).alias("id")).groupBy("id").agg(F.collect_set("keyword").alias("keywords"))
    own = rows.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("_text"))
    # explode would look into the texts twice more, to leave out those that hold nothing
    each = lambda df: df.select("id", F.explode_outer(_held("keywords", "_text")).alias("keyword")).where("keyword IS NOT NULL")
    found = each(candidates.join(own, "id"))
    # as many short keywords as there may be, in lists of about SHORT
    short = asked.where(F.length(F.lower("keyword")) < 3)
    block = F.pmod(F.xxhash64("keyword"), F.lit(-(-short.count() // SHORT) or 1))
    lists = short.groupBy(block.alias("block")).agg(F.collect_list("keyword").alias("keywords"))
    return found.unionByName(each(own.crossJoin(F.broadcast(lists)))).distinct().select("keyword", F.col("id").alias(id))
