"""Site-relative line frequency, by DataFrame functions only.

Lines are split at \\n and compared without outer spaces and tabs, A-Z in lower case; lines that are then
empty are never dropped. For each host (null: "") a line's pages are the host's different texts that hold
it, so copies count once; its ratio is pages by the host's different texts. Lines of `min_pages` pages and a ratio above `max_ratio`
are boilerplate and go, wherever they stand. A null text stays null; an emptied text is "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines (8 bytes each, of all hosts) up to which they are broadcast.
BROADCAST_LINES = 200_000


def _norm(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _keys(text: Column) -> Column:
    """A hash for each line, null for an empty one."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(_norm(x) != "", F.xxhash64(_norm(x))))


def boilerplate(docs: DataFrame, *, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and line (hash), with pages, host_pages and ratio, of the lines that are to go."""
    given = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    # a text's line hashes and its digest are enough from here on
    texts = given.select("host", F.md5("text").alias("digest"), _keys(F.col("text")).alias("keys")).groupBy("host", "digest").agg(F.first("keys").alias("keys"))
    lines = texts.select("host", F.explode(F.array_distinct("keys")).alias("line")).where(F.col("line").isNotNull())
    pages = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return pages.join(totals, "host").withColumn("ratio", F.col("pages") / F.col("host_pages")).where((F.col("pages") >= min_pages) & (F.col("ratio") > max_ratio))


def drop_lines(docs: DataFrame, *, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`row`, `text` without boilerplate lines, n_lines and n_dropped (long; 0 for a null text)."""
    found = materialise(boilerplate(docs, host=host, max_ratio=max_ratio, min_pages=min_pages).select("host", "line"), "boilerplate")
    given = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    if found.count() <= BROADCAST_LINES:
        joined = given.join(F.broadcast(found.groupBy("host").agg(F.collect_set("line").alias("drop"))), "host", "left")
    else:
        # lines of each text meet the boilerplate, and what is to go comes back by the text's digest
        keyed = given.withColumn("digest", F.md5("text"))
        own = keyed.select("host", "digest", F.explode(F.array_distinct(_keys(F.col("text")))).alias("line")).join(found, ["host", "line"])
        joined = keyed.join(own.groupBy("host", "digest").agg(F.collect_set("line").alias("drop")), ["host", "digest"], "left")
    lines = F.split("text", "\n", -1)
    stays = lambda x: ~F.coalesce(F.array_contains("drop", F.xxhash64(_norm(x))) & (_norm(x) != ""), F.lit(False))
    out = joined.withColumn("lines", lines).withColumn("left", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return out.select("row", F.array_join("left", "\n").alias("text"), size("lines").alias("n_lines"), (size("lines") - size("left")).alias("n_dropped"))


def clean(docs: DataFrame, **params) -> DataFrame:
    """The documents with their columns, boilerplate lines gone from the text."""
    out = drop_lines(docs, **params)
    return out.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
