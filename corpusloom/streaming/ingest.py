"""Replace-by-key ingest of a stream, and duplicates dropped within a watermark.

Each micro-batch is a folder of its own number below the table, so a batch that runs again after a restart replaces what it
had written: the table is the same as if it had run once. Nothing that is there is rewritten; a reader takes for each
key the rows of the last batch that has the key, and `compact` writes that down once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys have not come within `late`; state goes with the watermark, so it does not grow with the keys ever seen."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, *, mode: str = "append", now: bool = True) -> StreamingQuery:
    """Write each micro-batch, as `prepare` makes it, under `path`; it goes on from `checkpoint`. now: ends when what is there is read."""

    def write(batch: DataFrame, no: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/batch={no}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if now else writer).start()


def current(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The rows of the last batch that has their key; all of them, as a key's rows of a batch belong together. A null key is a key."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("batch").alias("_batch"))
    same = F.col("batch") == F.col("_batch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi").select(*schema.names)


def compact(spark: SparkSession, path: str, to: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The current rows as a table of one batch, below a path of its own; a stream that goes on with `to` begins with its next batch."""
    rows = current(spark, path, schema, keys)
    rows.write.parquet(f"{to}/batch=-1")
    return current(spark, to, schema, keys)
